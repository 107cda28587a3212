"""Best-fit packing of tokenized documents with certified bin counts.

A document is its ids and an end id. Only documents longer than the capacity are cut, from the end
into full pieces; what is left over is the first piece, and only such pieces have to be packed.

Pieces are dealt to partitions of a bounded size by a hash and packed there by best-fit decreasing.
Dual-feasible functions give each partition a lower bound of its bin count; where the count meets the
bound the partition is certified and final. Partitions with a gap, and the rest that whole partitions
leave in their emptiest bin, exchange documents: their loosest bins are opened, dealt anew and packed
again, for a few rounds, each into fewer partitions.

Null texts are empty documents of one end id. Repeated rows are packed as documents of their own.
Empty tables give no rows. Columns besides id and text are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, map_arrow, materialize, slices, text_buffers
from .pretokens import IdEncoder, encoder

#: Pieces in a partition.
PARTITION_PIECES = 40_000
ROUNDS = 3


def cut(length: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the first may be shorter, the others are full."""
    full, rest = divmod(length, capacity)
    return ([rest] if rest else []) + [capacity] * full


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, kept: int = IdEncoder.LIMIT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every document's pieces."""

    def run(batches):
        encode, encoder(path).limit = encoder(path).encode, kept
        for b in batches:
            raw, offsets = text_buffers(b.column(1))
            row, piece, start, length, crc = [], [], [], [], []
            for i, j in slices(offsets, slice_bytes):
                ids, at = encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                buffer = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                view = memoryview(buffer).cast("B")
                for r in range(j - i):
                    lo = int(at[r])
                    for p, n in enumerate(cut(int(at[r + 1]) - lo, capacity)):
                        row.append(i + r)
                        piece.append(p)
                        start.append(lo - int(at[r]))
                        length.append(n)
                        crc.append(zlib.crc32(view[4 * lo : 4 * (lo + n)]))
                        lo += n
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset of each piece, number of bins); lengths in any order."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    mask, bins = 0, 0  # bit r of mask: some bin has room r
    for i in order.tolist():
        n = int(lengths[i])
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        bin_of[i], offset[i] = b, capacity - room
        room -= n
        if room:
            by_room[room].append(b)
            mask |= 1 << room
    return bin_of, offset, bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound that the dual-feasible functions here give.

    u_k rounds lengths to k-ths of a bin, U_e drops pieces up to e and counts those above capacity - e as whole bins.
    """
    if len(lengths) == 0:
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * size).sum()) // capacity)
    for k in range(1, 33):  # u_k in units of 1 / (k * capacity)
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        value = np.where(whole, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    large = np.cumsum(counts[::-1])[::-1]  # pieces of at least this length
    mass = np.concatenate([[0], np.cumsum(counts * size)])
    e = np.arange(1, capacity // 2 + 1)
    above = np.concatenate([large, [0]])[capacity - e + 1]
    middle = mass[capacity - e + 1] - mass[e]
    return max(best, int((above + -(-middle // capacity)).max()))


def _pack(capacity: int, final: bool):
    """Packs one partition. kept: bins that stay; the others' pieces go to the next round."""

    def run(t: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        if pa.types.is_nested(t.schema.field("id").type):  # has no order in Arrow; the checksum stands for it
            order.pop(1)
        t = t.take(pc.sort_indices(t, sort_keys=order))
        lengths = t["length"].to_numpy()
        b, offset, bins = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(b, lengths, bins)
        gap = bins - lower_bound(lengths, capacity)
        open_ = np.zeros(bins, bool)
        if not final:
            # the last bin of any partition may be loose; a gap opens as many bins more, loosest first, with room to rearrange
            loose = np.argsort(fill, kind="stable")
            open_[loose[: 1 + 8 * gap]] = True
            open_ &= fill < capacity
        return t.append_column("bin", pa.array(b)).append_column("offset", pa.array(offset)).append_column("kept", pa.array(~open_[b])).append_column("gap", pa.array(np.full(len(b), gap)))

    return run


def certificate(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """(sequences, a lower bound of the sequences that any packing of these pieces needs); the driver reads a count per length."""
    counts = packed.groupBy("length").count().collect()
    lengths = np.repeat(np.array([r["length"] for r in counts], np.int64), [r["count"] for r in counts])
    return packed.select("sequence_id").distinct().count(), lower_bound(lengths, capacity)


def best_fit_pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", kept: int = IdEncoder.LIMIT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document.

    A worker keeps the ids of at most ``kept`` pieces of text and encodes ``slice_bytes`` at once: less of both
    takes less memory and more time.
    """
    all_pieces = materialize(pieces(docs, path, capacity, end_id, id_col, text_col, kept, slice_bytes), "pieces")
    n = all_pieces.where(F.col("length") < capacity).count()
    kind = all_pieces.schema["id"].dataType.simpleString()
    schema = f"part int, id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, bin bigint, offset bigint, kept boolean, gap bigint"
    cols = ["id", "piece", "start", "length", "ids_crc32"]
    todo, done = all_pieces.where(F.col("length") < capacity), []
    for r in range(ROUNDS + 1):
        parts = max(1, math.ceil(n / PARTITION_PIECES))
        final = r == ROUNDS or parts == 1
        part = F.pmod(F.xxhash64(F.lit(r), "id", "piece", "start", "ids_crc32"), F.lit(parts)).cast("int")
        packed = materialize(todo.select(*cols, part.alias("part")).groupBy("part").applyInArrow(_pack(capacity, final), schema), f"round{r}")
        # sequence ids: even ones for packed bins, numbered by round and partition
        sequence = ((F.col("bin") * F.lit(parts) + F.col("part")) * F.lit(ROUNDS + 1) + F.lit(r)) * 2
        done.append(packed.where("kept").select(*cols, sequence.alias("sequence_id"), "offset"))
        if final:
            break
        todo = packed.where("not kept")
        n = todo.count()
        if n == 0:
            break
    # full pieces are sequences of their own, with odd ids
    full = all_pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("bigint"))
    out = full.select(*cols, "sequence_id", "offset")
    for d in done:
        out = out.unionByName(d)
    return out.withColumnRenamed("id", id_col)
