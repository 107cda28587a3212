"""WARC archives compressed with an embedded Zstandard dictionary.

Each archive (``.warc.zst``) begins with a skippable frame that holds a dictionary trained on the
archive's own records; every record is a frame of its own, compressed with it. Of the records with
equal payloads, that with the smallest id is stored as a response; the others are revisit records
that refer to it and carry the HTTP header, but not the payload.

Null payloads are empty. Payloads smaller than ``min_revisit_bytes`` are always responses. Repeated
rows with the smallest id are responses each. Rows with a null id revisit their payload's first
record, or are responses where no row with that payload has an id. Line ends in urls are
percent-encoded; a null url has no header. Archives with too few records to train on have no
dictionary frame. Columns besides id, url and payload are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, read_shared, shared_dir, spread, write_shared

MAGIC = 0x184D2A5D  # the skippable frame of a dictionary
ARCHIVE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES = 16 << 20, 2 << 20, 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to, date: str) -> bytes:
    """One WARC record; payload None makes it a revisit of the record refers_to."""
    urn = lambda x: f"<urn:x-record:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {date}",
        *([] if url is None else ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A")]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if payload is not None else [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = 6) -> bytes:
    """The records' archive: dictionary frame, then a frame for each record."""
    total = sum(map(len, records))
    step = max(1, -(-total // TRAIN_BYTES))
    samples = records[::step]
    try:
        book = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 16)), samples) if len(samples) >= 16 else None
    except zstandard.ZstdError:  # too little to learn from
        book = None
    press = zstandard.ZstdCompressor(level=level, dict_data=book, write_content_size=True)
    out = [] if book is None else [struct.pack("<II", MAGIC, len(book.as_bytes())), book.as_bytes()]
    return b"".join([*out, *map(press.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at this place ends, from its headers alone."""
    flags = data[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:  # blocks: the last one's flag, the kind (1: a repeated byte), the size
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * checksum


def records_of(data: bytes):
    """(headers, block) of each record of an archive."""
    book, at = None, 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        book, at = zstandard.ZstdCompressionDict(data[8 : 8 + n]), 8 + n
    unpress = zstandard.ZstdDecompressor(dict_data=book)
    view = memoryview(data)
    while at < len(data):
        end = frame_end(view, at)
        raw = unpress.decompress(view[at:end])
        at = end
        head, _, rest = raw.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) for x in lines)
        yield headers, rest[: int(headers["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write all pages to archives in folder (a shared one); returns the written manifest: path, records, bytes."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1"), F.octet_length(payload).alias("n"))
    same = rows.where(F.col("n") >= min_revisit_bytes).groupBy("sha1", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c"))
    # written first, so that both sides of the join are plain shuffles and a hot payload's partition can be split
    same = materialize(same.where("c > 1").select("sha1", "n", "first"), "same")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.join(same, ["sha1", "n"], "left").withColumn("revisit", revisit)
    rows = rows.select("id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), F.col("n").cast("bigint").alias("n"), "sha1", F.when(F.col("revisit"), F.col("first")).alias("first"))

    def run(batches):
        task, files, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal files, held, size
            path, data = f"{folder}/part-{task:06d}-{files:05d}.warc.zst", archive(held)
            write_shared(path, data)
            row = pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)], "bytes": [len(data)]}, schema=manifest)
            files, held, size = files + 1, [], 0
            return row

        manifest = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
        for b in batches:
            ids, urls, payloads, sizes, digests, firsts = (b.column(i) for i in range(6))
            for i in range(b.num_rows):
                body = payloads[i].as_py()
                digest = base64.b32encode(bytes.fromhex(digests[i].as_py())).decode()
                r = record(ids[i].as_py(), urls[i].as_py(), None if body is None else body.encode(), sizes[i].as_py(), digest, firsts[i].as_py(), date)
                held.append(r)
                size += len(r)
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    return materialize(map_arrow(rows, run, "path string, records bigint, bytes bigint"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Of the archives that a manifest lists: record_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of every record; digests of responses are verified."""
    files = spread(manifest.select("path"))
    kinds = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])

    def run(batches):
        bare = lambda x: (x or "<urn:x-record:>")[len("<urn:x-record:") : -1] or None
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                for head, block in records_of(read_shared(path)):
                    http, _, body = block.partition(b"\r\n\r\n")
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                    n = int(http.lower().partition(b"content-length: ")[2].split(b"\r\n")[0])
                    if kind == "response" and (len(body) != n or base32_sha1(body) != digest):
                        raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                    rows.append((bare(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), n, digest, kind, bare(head.get("WARC-Refers-To")), body if kind == "response" else None))
                    size += len(body)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    return map_arrow(files, run, "record_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Write pages to archives and list the records read back: id, payload_bytes, payload_digest, record_type, refers_to."""
    spark, folder = pages.sparkSession, f"{shared_dir(pages.sparkSession)}/archives"
    manifest = write_archives(pages, folder, id_col, **options)
    kind = pages.schema[id_col].dataType.simpleString()
    if manifest.isEmpty():
        return spark.createDataFrame([], f"{id_col} {kind}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}")
    back = read_archives(manifest).drop("payload")
    return back.select(F.col("record_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
