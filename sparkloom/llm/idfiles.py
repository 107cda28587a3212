"""Token-id files: whole texts as ids, in order of the document ids, range-coded in independent blocks.

A file holds a directory (JSON, deflated: document ids, ids per document, and for each block its ids,
its coded words and the CRC-32 of its ids) and the blocks. Files are numbered in order of the document
ids; a document's place among all ids is its file's offset plus its place in the file.

Texts are range-partitioned by document id and sorted in each partition, encoded and written by the
task; a retried task replaces its files by the same ones. Null texts are empty; every document ends
with the end id, so none is lost. Null ids come first, repeated rows are documents of their own in
order of their text's hash. Ids must be below 65536. Columns besides id and text are not read.
"""

from __future__ import annotations

import base64
import json
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import idcoder
from .common import map_arrow, materialize, read_shared, shared_dir, slices, spread, text_buffers, write_shared
from .pretokens import encoder

MAGIC = b"SLID\x00\x00\x00\x02"
#: Ids of a file, about: its blocks are coded together, so that larger files take less time for each id and more memory (some 30 bytes an id).
FILE_IDS = 12_000_000
#: Distinct pieces of text whose ids a task keeps, some 40 bytes each, and bytes of text that it encodes at once.
PIECES, ENCODE_BYTES = 1_800_000, 1 << 20
#: Aimed-for text in one range of documents, in characters, and how many ranges there are at most. A range is written
#: file by file, so its size does not bound memory.
RANGE_CHARS, MAX_RANGES = 24 << 20, 50_000
#: Ranges whose files' counts are summed together before the sums are.
SPAN = 256


def _packed(values: np.ndarray, kind: str) -> str:
    return base64.b64encode(values.astype(kind).tobytes()).decode()


def _unpacked(text: str, kind: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), kind)


def pack_file(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    blocks = idcoder.encode(ids)
    starts = np.arange(len(blocks)) * idcoder.BLOCK
    crc = [zlib.crc32(ids[s : s + n].astype("<u4").tobytes()) for s, (n, _) in zip(starts.tolist(), blocks, strict=True)]
    head = {"docs": doc_ids, "counts": _packed(counts, "<u4"), "ids": _packed(np.array([n for n, _ in blocks]), "<u4"), "words": _packed(np.array([len(w) for _, w in blocks]), "<u4"), "crc": _packed(np.array(crc, np.uint32), "<u4")}
    directory = zlib.compress(json.dumps(head).encode())
    return b"".join([MAGIC, struct.pack("<Q", len(directory)), directory, *(w.astype("<u2").tobytes() for _, w in blocks)])


def unpack_file(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, ids per document, all ids); raises where a block's checksum fails."""
    if data[:8] != MAGIC:
        raise ValueError("not a token-id file")
    n = struct.unpack_from("<Q", data, 8)[0]
    try:
        head = json.loads(zlib.decompress(data[16 : 16 + n]))
    except zlib.error as e:
        raise ValueError("the directory is damaged") from e
    sizes, words, crc = (_unpacked(head[k], "<u4") for k in ("ids", "words", "crc"))
    body = np.frombuffer(data, "<u2", offset=16 + n)
    ends = np.cumsum(words.astype(np.int64))
    ids = idcoder.decode([(int(s), body[e - w : e]) for s, e, w in zip(sizes, ends.tolist(), words.tolist(), strict=True)])
    at = 0
    for s, c in zip(sizes.tolist(), crc.tolist(), strict=True):
        if zlib.crc32(ids[at : at + s].astype("<u4").tobytes()) != c:
            raise ValueError("a block of ids is damaged")
        at += s
    return head["docs"], _unpacked(head["counts"], "<u4").astype(np.int64), ids


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to files in folder (a shared one); returns the written manifest: part, file, path, n_ids."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = min(MAX_RANGES, max(1, math.ceil(chars / RANGE_CHARS)))
    tie = F.xxhash64("text")
    rows = rows.withColumn("tie", tie).repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie", "text")

    def run(batches):
        task, files = TaskContext.get().partitionId(), 0
        own = encoder(path)
        own.limit, encode = PIECES, own.encode
        doc_ids, counts, held, size = [], [], [], 0
        schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64())])

        def flush():
            nonlocal doc_ids, counts, held, size, files
            name = f"{folder}/part-{task:06d}-{files:06d}.ids"
            ids, held = np.concatenate(held), []
            write_shared(name, pack_file(doc_ids, np.concatenate(counts), ids))
            row = pa.RecordBatch.from_pydict({"part": [task], "file": [files], "path": [name], "n_ids": [size]}, schema=schema)
            doc_ids, counts, held, size, files = [], [], [], 0, files + 1
            return row

        for b in batches:
            raw, offsets = text_buffers(b.column(1))
            for i, j in slices(offsets, ENCODE_BYTES):
                ids, at = encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                held.append(np.insert(ids, at[1:], end_id))
                counts.append(np.diff(at) + 1)
                doc_ids += b.column(0).slice(i, j - i).to_pylist()
                size += len(held[-1])
                if size >= FILE_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    return materialize(map_arrow(rows, run, "part int, file int, path string, n_ids bigint"), "manifest")


def read_ids(manifest: DataFrame, kind: str = "bigint", with_ids: bool = False) -> DataFrame:
    """id, start, n_tokens, ids_crc32 (and ids) of every document in the files that a manifest lists."""

    def run(batches):
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs, counts, ids = unpack_file(read_shared(path))
                ends = np.cumsum(counts)
                view = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                cols = [pa.array(docs), pa.array(ends - counts + before), pa.array(counts), pa.array(crc, pa.int64())]
                names = ["id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    # running counts of files within spans of ranges, and of the at most MAX_RANGES / SPAN spans
    files = manifest.withColumn("span", F.floor(F.col("part") / SPAN))
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = files.groupBy("span").agg(F.sum("n_ids").alias("n_ids")).select("span", before(Window.orderBy("span")).alias("spans_before"))
    files = files.withColumn("files_before", before(Window.partitionBy("span").orderBy("part", "file"))).join(spans, "span")
    files = materialize(files.select("path", (F.col("files_before") + F.col("spans_before")).alias("before")), "offsets")
    return map_arrow(spread(files), run, f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def id_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", **options) -> DataFrame:
    """Write docs as ids and list the documents read back: id, start, n_tokens, ids_crc32."""
    spark, folder = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/ids"
    kind = docs.schema[id_col].dataType.simpleString()
    manifest = write_ids(docs, path, folder, id_col=id_col, **options)
    if manifest.isEmpty():
        return spark.createDataFrame([], f"{id_col} {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
    return read_ids(manifest, kind).withColumnRenamed("id", id_col)
