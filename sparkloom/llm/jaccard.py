"""Exact n-gram Jaccard join by parity sketches.

A text's set of 5-word shingles is hashed; each hash flips one bit of the set's parity sketch, so the
Hamming distance of two sketches is a lower bound of the sets' symmetric difference. At a similarity
of t the difference d is bounded by the sizes. Per size band the hash space is cut into K > d segments,
each with a parity word; by the pigeonhole principle two linked sets agree in at least K - d
words, so some word is among the first d + 1 of both, which are the join's keys.

The order in which words become keys is free, as long as all sets share it. Words that several sets of
a sample hold come last, so that passages which many texts share are keys only where a text has little
else; the sample decides the order alone, never the result.

Sets that are equal form one class, and only classes are joined. Of all classes with a key, each is
paired with the smallest (a star, built per task first, so that a hot key is one row per task later).
Pairs whose sizes or sketches rule a link out are dropped; the others are verified on the sets
themselves: first each class with the one it shares most keys with, then what is left between
components. Classes of a key that these links leave in different components are then compared with
each other, in blocks of bounded size by sketch, and verified too. So every link that could join two
components is found, and no group of copies is ever expanded into its pairs.

With ``links`` every link is found besides: as both its ends are in one component, the classes of each
component are all compared with each other, in blocks of bounded size and on the sets themselves. Each
text's links are counted where they are found, so that pairs never become rows.

Where a large table is joined with a few rows of it, a bitmap drops most others first; it has some 16 bits
for each of these rows, and at most ``FILTER_BITS``, beyond which it only drops fewer. Sets that were
computed for one round are kept for the next ones, and every written table goes after its last use.

Null and empty texts have empty sets and are linked with nothing. Rows with a null id take part, but
give no component its name; a component of such rows only has a null id. Repeated rows share a class.
Columns besides id and text are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import drop_table, map_arrow, materialize, slices, text_buffers
from .pretokens import forget, mix
from .shingles import KEY_BYTES, fold, segment_keys, shingle_sets, sketches

#: Keys that a task sorts at once, before the shuffle and, slot by slot, after it; partitions of slots at most; classes
#: of one block of a key.
CHUNK_KEYS, SLOT_KEYS, MAX_PARTS, BLOCK = 750_000, 400_000, 20_000, 1_000
#: Hashes of one block of a component's sets.
BLOCK_HASHES = 1_000_000
#: Pairs that a task remembers having given; when it forgets them, repeated ones are dropped after the shuffle alone.
GIVEN = 300_000
#: Bits at most of the filters that pick rows before a join (16 MB), and bits for each row that they mark.
FILTER_BITS, BITS_PER_ROW = 1 << 27, 16
#: One text in so many is looked at to find common words, and how many of them share such a word.
SAMPLE, COMMON = 16, 3
SLICE = 1 << 19


def class_ids(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, by order-free sums of two mixes."""
    size = np.diff(at)
    total = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    one, two = total(mix(sets ^ np.uint64(0xA0761D6478BD642F))), total(mix(sets + np.uint64(0xE7037ED1A0B428DB)))
    return mix((one[at[1:]] - one[at[:-1]]) ^ mix(two[at[1:]] - two[at[:-1]]) + size.astype(np.uint64)).view(np.int64)


def bitmap(marked: DataFrame, c: str) -> np.ndarray:
    """Bits that are on for each value of the hash c of a written table; the words come to the driver, at most 2^21 of them."""
    bits = min(FILTER_BITS, max(1 << 16, 1 << (BITS_PER_ROW * marked.count()).bit_length()))
    slot = F.col(c).bitwiseAND(bits - 1)
    words = marked.select((slot / 64).cast("int").alias("w"), slot.cast("int").bitwiseAND(63).alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    got = words.toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def on(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.astype(np.int64) & (8 * len(bits) - 1)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _groups(batches, keys: int):
    """Tables of the rows that agree in the first so many columns, of batches in order of these."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in range(keys)]
        cut = np.flatnonzero(functools.reduce(np.logical_or, [c[1:] != c[:-1] for c in cols])) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            own = tuple(c[lo] for c in cols)
            if own != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = own
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _sampled_words(percent: int):
    def run(batches):
        for b in batches:
            raw, offsets = text_buffers(b.column(0))
            for i, j in slices(offsets, SLICE):
                sets, at = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cid = class_ids(sets, at)
                keys, docs = (np.concatenate(x) for x in zip(segment_keys(sets, at, percent, False), segment_keys(sets, at, percent, True), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(cid[docs])], ["key", "cid"])

    return run


def _signatures(percent: int, common):
    def run(batches):
        forget()
        seen: set[int] = set()
        last = lambda keys: on(common.value, keys)
        for b in batches:
            raw, offsets = text_buffers(b.column(1))
            for i, j in slices(offsets, SLICE):
                sets, at = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size, cid = np.diff(at), class_ids(sets, at)
                new = np.zeros(j - i, bool)
                for r, (c, n) in enumerate(zip(cid.tolist(), size.tolist(), strict=True)):
                    if n and c not in seen:
                        seen.add(c)
                        new[r] = True
                keys, docs = (np.concatenate(x) for x in zip(segment_keys(sets, at, percent, False, last), segment_keys(sets, at, percent, True, last), strict=True))
                keep = new[docs]
                order = np.argsort(docs[keep], kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(docs[keep], minlength=j - i))])
                held = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((KEY_BYTES * ends).astype(np.int32)), pa.py_buffer(_short(keys[keep][order]))])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(cid, mask=size == 0), pa.array(sketches(sets, at), pa.binary(), mask=~new), held], ["id", "n", "cid", "sketch", "keys"])

    return run


def _short(keys: np.ndarray) -> bytes:
    """Keys in KEY_BYTES bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _long(data) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.reshape(-1).view("<i8")


def _keys_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all rows, keys of each row)."""
    rows = [x.as_py() or b"" for x in column]
    return _long(b"".join(rows)), np.array([len(x) // KEY_BYTES for x in rows], np.int64)


def _runs(key: np.ndarray, cid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, cid) in order, and the position of each one's first of the same key."""
    order = np.lexsort((cid, key))
    key, cid = key[order], cid[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])
    key, cid = key[keep], cid[keep]
    start = np.ones(len(key), bool)
    start[1:] = key[1:] != key[:-1]
    return key, cid, np.flatnonzero(start)[np.cumsum(start) - 1] if len(key) else np.zeros(0, np.int64)


_STAR = pa.schema([("part", pa.int32()), ("blob", pa.binary()), ("key", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])


def _edges_batch(key, x, y, part):
    n = len(key)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.nulls(n, pa.binary()), pa.array(key), pa.array(x), pa.array(y)], schema=_STAR)


def _local_stars(parts: int):
    """Per chunk of a task: edges to each key's smallest class, and that class alone, packed by slot."""

    def flush(key, cid):
        key, cid, lead = _runs(key, cid)
        other = np.flatnonzero(lead != np.arange(len(lead)))
        if len(other):
            yield _edges_batch(key[other], cid[other], cid[lead[other]], (mix(key[other].view(np.uint64)) % np.uint64(parts)).astype(np.int32))
        first = np.flatnonzero(lead == np.arange(len(lead)))
        key, cid = key[first], cid[first]
        part = (mix(key.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        used, start = np.unique(part[order], return_index=True)
        ends = [*start[1:].tolist(), len(order)]
        key, cid = key[order], cid[order]
        blobs = [_short(key[lo:hi]) + cid[lo:hi].tobytes() for lo, hi in zip(start.tolist(), ends, strict=True)] if len(order) else []
        n = len(blobs)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary()), *(pa.nulls(n, pa.int64()) for _ in range(3))], schema=_STAR)

    def run(batches):
        keys, cids, held = [], [], 0
        for b in batches:
            own, lens = _keys_of(b.column(1))
            keys.append(own)
            cids.append(np.repeat(b.column(0).fill_null(0).to_numpy(), lens))
            held += len(keys[-1])
            if held >= CHUNK_KEYS:
                yield from flush(np.concatenate(keys), np.concatenate(cids))
                keys, cids, held = [], [], 0
        if held:
            yield from flush(np.concatenate(keys), np.concatenate(cids))

    return run


_EDGES = pa.schema([("key", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])


def _global_stars(batches):
    """Edges to the smallest class of each key, of rows in order of their slot; edges of tasks pass through."""

    def flush(held):
        key, cid, lead = _runs(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        other = np.flatnonzero(lead != np.arange(len(lead)))
        if len(other):
            yield pa.RecordBatch.from_arrays([pa.array(key[other]), pa.array(cid[other]), pa.array(cid[lead[other]])], schema=_EDGES)

    held, slot = [], None
    for b in batches:
        edge = np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False))
        if len(edge):
            yield pa.RecordBatch.from_arrays([b.column(k).take(pa.array(edge)) for k in (2, 3, 4)], schema=_EDGES)
        for s, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if s != slot and held:
                yield from flush(held)
                held = []
            slot = s
            if blob.is_valid:
                data = blob.as_py()
                n = len(data) // (KEY_BYTES + 8)
                held.append((_long(data[: KEY_BYTES * n]), np.frombuffer(data, np.int64, n, KEY_BYTES * n)))
    if held:
        yield from flush(held)


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches, the longer one folded to the shorter."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), len(a)
    while size > len(b):
        size //= 2
        x = (x >> (8 * size)) ^ (x & ((1 << (8 * size)) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _possible(percent: int):
    """Keeps (x, y, c) whose sketches allow a link."""

    def run(batches):
        for b in batches:
            n, m, s, t = (b.column(i).to_pylist() for i in range(3, 7))
            # a difference d needs 100 (a + b - d) >= percent (a + b + d)
            keep = pa.array([(100 + percent) * hamming(s[i], t[i]) <= (100 - percent) * (n[i] + m[i]) for i in range(len(n))], pa.bool_())
            yield b.select([0, 1, 2]).filter(keep)

    return run


def _linked(percent: int):
    def run(batches):
        for b in batches:
            x, y, s, t = (b.column(i) for i in range(4))
            keep = []
            for i in range(b.num_rows):
                one, two = np.frombuffer(s[i].as_buffer(), np.uint64), np.frombuffer(t[i].as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(two, one), len(two) - 1)
                same = int((two[at] == one).sum())
                if 100 * same >= percent * (len(one) + len(two) - same):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([x.take(at), y.take(at)], ["x", "y"])

    return run


def _sets_of(marks):
    """(cid, sorted hashes) of the texts whose id's hash is marked."""

    def run(batches):
        for b in batches:
            rows = np.flatnonzero(on(marks.value, b.column(1).to_numpy()))
            if not len(rows):
                continue
            raw, offsets = text_buffers(b.column(0).take(pa.array(rows)))
            for i, j in slices(offsets, SLICE):
                sets, at = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cid, size = class_ids(sets, at), np.diff(at)
                data = [sets[a:e].tobytes() for a, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(cid, mask=size == 0), pa.array(data, pa.binary())], ["cid", "hashes"])

    return run


def _marked_classes(marks):
    """Rows (cid, n, sketch) whose class is marked."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(on(marks.value, b.column(0).to_numpy())))

    return run


def _marked_keys(marks):
    """(key, cid) of the marked keys of rows (cid, keys)."""

    def run(batches):
        for b in batches:
            keys, lens = _keys_of(b.column(1))
            hit = on(marks.value, keys)
            cid = np.repeat(b.column(0).to_numpy(), lens)
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(cid[hit])], ["key", "cid"])

    return run


class _Join:
    """The tables that all rounds of the join share, and what is known of the classes so far."""

    def __init__(self, docs: DataFrame, sig: DataFrame, percent: int):
        self.docs, self.sig, self.percent = docs, sig, percent
        self.share = docs.sparkSession.sparkContext.broadcast
        self.links: list[DataFrame] = []
        self.held: list[DataFrame] = []  # sets of the classes asked for so far
        self.label = None

    def classes(self, asked: DataFrame) -> DataFrame:
        """cid, n, s (sketch) of the asked classes (cid, a written table)."""
        known = self.sig.where("sketch is not null").select("cid", "n", "sketch")
        own = map_arrow(known, _marked_classes(self.share(bitmap(asked, "cid"))), "cid bigint, n bigint, sketch binary")
        return materialize(own.join(asked, "cid", "left_semi").groupBy("cid").agg(F.first("n").alias("n"), F.first("sketch").alias("s")), "classes")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y, c) of classes that sizes and sketches allow."""
        asked = materialize(_both(pairs), "asked")
        known = self.classes(asked)
        rows = pairs.join(known.toDF("x", "n", "s"), "x").join(known.toDF("y", "m", "t"), "y")
        rows = rows.where(100 * F.least("n", "m") >= self.percent * F.greatest("n", "m")).select("x", "y", "c", "n", "m", "s", "t")
        out = materialize(map_arrow(rows, _possible(self.percent), "x bigint, y bigint, c bigint"), "possible")
        drop_table(asked, known)
        return out

    def sets(self, asked: DataFrame) -> DataFrame:
        """cid, s (sorted hashes) of the asked classes (cid, a written table), each from one of its texts; kept for later rounds."""
        new = asked
        for t in self.held:
            new = new.join(t.select("cid"), "cid", "left_anti")
        new = materialize(new, "new") if self.held else asked
        if not new.isEmpty():
            own = self.sig.where("n > 0").select("cid", F.xxhash64("id").alias("h"))
            named = materialize(own.join(new, "cid", "left_semi").groupBy("cid").agg(F.min("h").alias("h")), "named")
            texts = self.docs.select("text", F.xxhash64("id").alias("h"))
            got = map_arrow(texts, _sets_of(self.share(bitmap(named, "h"))), "cid bigint, hashes binary").where("cid is not null")
            self.held.append(materialize(got.join(new, "cid", "left_semi").groupBy("cid").agg(F.first("hashes").alias("s")), "sets"))
            drop_table(named)
        if new is not asked:
            drop_table(new)
        return functools.reduce(DataFrame.unionByName, self.held).join(asked, "cid", "left_semi")

    def verify(self, pairs: DataFrame) -> None:
        """Take up the pairs (a written table, which goes) that are linked, held against the sets of one text of each class."""
        if not pairs.isEmpty():
            asked = materialize(_both(pairs), "asked")
            sets = self.sets(asked)
            rows = pairs.join(sets.toDF("x", "s"), "x").join(sets.toDF("y", "t"), "y").select("x", "y", "s", "t")
            self.links.append(materialize(map_arrow(rows, _linked(self.percent), "x bigint, y bigint"), "links"))
            drop_table(asked, self.label)
            self.label = components(self.all_links(), PART_ROUNDS)
        drop_table(pairs)

    def all_links(self) -> DataFrame | None:
        return functools.reduce(DataFrame.unionByName, self.links) if self.links else None

    def cross(self, member: DataFrame, own: DataFrame, tested: DataFrame, whole: bool) -> DataFrame:
        """x, y: possible pairs of classes of one key (member) that are in different components so far, but for the tested ones."""
        if self.label is not None:
            own = own.join(self.label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("label", "cid")).drop("label")
        else:
            own = own.withColumn("comp", F.col("cid"))
        own = materialize(own, "own")
        # keys whose classes have all come together have nothing left to compare
        mixed = materialize(member.join(own.select("cid", "comp"), "cid").groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key"), "mixed")
        left = member.join(mixed, "key", "left_semi")
        grid = _grid(left, "key", "cid").join(own, "cid").select("key", "i", "j", "side", "cid", "comp", "n", "s")
        work = left.join(own.select("cid", "n"), "cid").agg(F.sum(F.col("blocks") * (F.col("n") + BLOCK_HASHES // BLOCK))).first()[0] or 0
        parts = max(1, math.ceil(work / (4 * BLOCK_HASHES)))
        near = map_arrow(grid.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j"), _cross(self.percent, whole), "x bigint, y bigint").distinct()
        out = materialize(near.join(tested, ["x", "y"], "left_anti"), "more")
        drop_table(own, mixed)
        return out

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose classes are in different components so far."""
        if self.label is None:
            return pairs
        of = lambda c: self.label.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        rows = pairs.join(of("x"), "x", "left").join(of("y"), "y", "left")
        return rows.where(F.coalesce("x_label", "x") != F.coalesce("y_label", "y")).select(*pairs.columns)

    def close(self) -> None:
        drop_table(self.label, *self.links, *self.held)


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("cid")).distinct()


def _blocks(classes, hashes):
    """Into how many blocks of bounded size a group of so many classes and hashes is dealt."""
    return F.greatest(F.ceil(classes / BLOCK), F.ceil(hashes / BLOCK_HASHES)).cast("int")


def _grid(rows: DataFrame, key: str, *carried: str) -> DataFrame:
    """Rows (key, blocks, cid, ..) dealt to blocks and copied to each pair of these: key, i, j, side, carried."""
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    pair = lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), (F.col("block") > o).cast("int").alias("side"))
    grid = rows.withColumn("block", block).withColumn("g", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)))
    return grid.select(key, "g.*", *carried)


def _distances(sketch: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of the sketches at a and b, the longer one of each folded to the shorter."""
    bits = np.array([len(x) for x in sketch])
    own, place = {}, np.zeros(len(sketch), np.int64)  # by length: a matrix of the sketches; the row of each in it
    for size in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == size)
        place[rows] = np.arange(len(rows))
        own[size] = np.frombuffer(b"".join([sketch[r] for r in rows.tolist()]), np.uint64).reshape(len(rows), -1)
    out = np.zeros(len(a), np.int64)
    kind = bits[a] * (1 << 32) + bits[b]
    for both in np.unique(kind).tolist():
        at, size = np.flatnonzero(kind == both), min(both >> 32, both & 0xFFFFFFFF)
        one, two = fold(own[both >> 32], size // 8), fold(own[both & 0xFFFFFFFF], size // 8)
        step = max(1, (4 << 20) // size)
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            out[some] = np.bitwise_count(one[place[a[some]]] ^ two[place[b[some]]]).sum(1, dtype=np.int64)
    return out


def _spanning(x: np.ndarray, y: np.ndarray, order: np.ndarray) -> list[int]:
    """The pairs (x, y), taken in this order, that join what the ones before left apart."""
    root: dict[int, int] = {}

    def find(v):
        while root.get(v, v) != v:
            v = root[v]
        return v

    keep = []
    for k in order.tolist():
        one, two = find(int(x[k])), find(int(y[k]))
        if one != two:
            root[max(one, two)] = min(one, two)
            keep.append(k)
    return keep


def _cross(percent: int, whole: bool):
    """Possible pairs between different components, for the groups (key, i, j) of a partition in order of these.

    Where a group has many more than classes, and unless whole is asked for, only as many as could join
    the components are given, the closest first. Groups of bounded size are looked at some at a time.
    """

    def look(held):
        t = pa.concat_tables(held)
        group = np.repeat(np.arange(len(held)), [x.num_rows for x in held])
        side, cid, comp, n = (t.column(k).to_numpy() for k in (3, 4, 5, 6))
        order = np.lexsort((cid, n, side, group))
        group, side, cid, comp, n = (x[order] for x in (group, side, cid, comp, n))
        # sizes ascend in each side of a group, so that those in reach of a row are a range
        place = (2 * group + side) * (1 << 40) + n
        two = np.bincount(group, side).astype(bool)[group]  # a group of two blocks, else of one with itself
        probe = np.flatnonzero(side == 0)
        base = (2 * group[probe] + two[probe]) * (1 << 40)
        lo = np.where(two[probe], np.searchsorted(place, base - (-n[probe] * percent // 100)), probe + 1)
        hi = np.searchsorted(place, base + n[probe] * 100 // percent, "right")
        size = np.maximum(hi - lo, 0)
        a = np.repeat(probe, size)
        b = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        open_ = comp[a] != comp[b]
        a, b = a[open_], b[open_]
        if not len(a):
            return None
        d, total = _distances(t.column(7).take(pa.array(order)).to_pylist(), a, b), n[a] + n[b]
        ok = (100 + percent) * d <= (100 - percent) * total
        a, b, share = a[ok], b[ok], d[ok] / total[ok]
        if not whole:
            many = np.bincount(group[a], minlength=len(held)) > 4 * np.bincount(group, minlength=len(held))
            keep = [np.flatnonzero(~many[group[a]])]
            for g in np.flatnonzero(many).tolist():
                at = np.flatnonzero(group[a] == g)
                closest = np.lexsort((cid[b[at]], cid[a[at]], share[at]))
                keep.append(at[_spanning(comp[a[at]], comp[b[at]], closest)])
            keep = np.concatenate(keep)
            a, b = a[keep], b[keep]
        return np.unique(np.stack([np.minimum(cid[a], cid[b]), np.maximum(cid[a], cid[b])], 1), axis=0)

    def run(batches):
        held, rows = [], 0
        given: set[tuple[int, int]] = set()  # pairs that share several keys of the task leave it once

        def new():
            if (pairs := look(held)) is None:
                return
            some = [p for p in map(tuple, pairs.tolist()) if p not in given]
            if len(given) > GIVEN:
                given.clear()
            given.update(some)
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], ["x", "y"])

        for t in _groups(batches, 3):
            held.append(t)
            rows += t.num_rows
            if rows >= 2 * BLOCK:
                yield from new()
                held, rows = [], 0
        if held:
            yield from new()

    return run


def _links(percent: int):
    """(cid, links): how many rows each class is linked with in other classes, for each (label, i, j) of a partition."""

    def run(batches):
        for t in _groups(batches, 3):
            side, cid, n, m = (t.column(k).to_numpy() for k in (3, 4, 5, 6))
            order = np.lexsort((cid, n, side))
            side, cid, n, m = side[order], cid[order], n[order], m[order]
            blobs = t.column(7).combine_chunks()
            mid = int(np.searchsorted(side, 1))
            same = mid == len(side)  # a block with itself
            _, code = np.unique(np.concatenate([np.frombuffer(blobs[r].as_buffer(), np.uint64) for r in order.tolist()]), return_inverse=True)
            at = np.concatenate([[0], np.cumsum(n)])
            mark, links = np.zeros(len(code), np.int32), np.zeros(len(cid), np.int64)
            for a in range(mid):
                b0, b1 = (a + 1, mid) if same else (mid, len(side))
                # sizes ascend, so that those in reach are a range
                b0, b1 = b0 + int(np.searchsorted(n[b0:b1], -(-n[a] * percent // 100))), b0 + int(np.searchsorted(n[b0:b1], n[a] * 100 // percent, "right"))
                if b0 >= b1:
                    continue
                own = code[at[a] : at[a + 1]]
                mark[own] = 1
                shared = np.add.reduceat(mark[code[at[b0] : at[b1]]], at[b0:b1] - at[b0], dtype=np.int64)
                mark[own] = 0
                found = np.flatnonzero(100 * shared >= percent * (n[a] + n[b0:b1] - shared)) + b0
                links[a] += m[found].sum()
                links[found] += m[a]
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some])], ["cid", "links"])

    return run


def _all_links(join: _Join, label: DataFrame) -> DataFrame:
    """cid, m (its rows), links (rows of other classes that it is linked with); label (cid, label) has all components."""
    rows = join.sig.where("n > 0").groupBy("cid").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("m")).join(label, "cid")
    rows = materialize(rows, "rows")
    size = rows.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("all")).where("c > 1")
    asked = materialize(rows.join(size.select("label", _blocks(F.col("c"), F.col("all")).alias("blocks")), "label"), "asked")
    if asked.isEmpty():
        return rows.select("cid", "m", F.lit(0).cast("bigint").alias("links"))
    grid = _grid(asked, "label", "cid", "n", "m").join(join.sets(asked.select("cid")), "cid").select("label", "i", "j", "side", "cid", "n", "m", "s")
    parts = max(1, math.ceil((asked.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0) / (2 * BLOCK_HASHES)))
    found = map_arrow(grid.repartition(parts, "label", "i", "j").sortWithinPartitions("label", "i", "j"), _links(join.percent), "cid bigint, links bigint")
    found = materialize(found.groupBy("cid").agg(F.sum("links").alias("links")), "found")
    drop_table(asked)
    return rows.select("cid", "m").join(found, "cid", "left").select("cid", "m", F.coalesce("links", F.lit(0)).alias("links"))


#: Keys of so many classes are first looked at by one key per class, in so many rounds, so that large groups
#: come together before all that is left between components is compared.
LARGE, FOREST_ROUNDS = 32, 2
#: Rounds of label propagation between rounds of the join; labels that have not met yet only cost comparisons.
PART_ROUNDS = 2


def _candidates(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: sig (id, n, cid, sketch), keyed (cid, keys), edges (key, x, y)."""
    kind, share = docs.schema["id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast
    sampled = map_arrow(docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("text"), _sampled_words(percent), "key bigint, cid bigint")
    common = materialize(sampled.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON), "common")
    seen = share(bitmap(common, "key"))
    drop_table(common)
    sig = materialize(map_arrow(docs, _signatures(percent, seen), f"id {kind}, n bigint, cid bigint, sketch binary, keys binary"), "signatures")
    total = (sig.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // KEY_BYTES
    slots = max(1, math.ceil(total / SLOT_KEYS))
    keyed = sig.where(F.octet_length("keys") > 0).select("cid", "keys")
    stars = map_arrow(keyed, _local_stars(slots), "part int, blob binary, key bigint, x bigint, y bigint")
    return sig, keyed, materialize(map_arrow(stars.repartition(min(slots, MAX_PARTS), "part").sortWithinPartitions("part"), _global_stars, "key bigint, x bigint, y bigint"), "edges")


def _compare_loose(join: _Join, keys: DataFrame, keyed: DataFrame, edges: DataFrame, pairs: DataFrame) -> None:
    """Compare with each other the classes of keys of three or more, whose star left them in different components."""
    apart = materialize(join.apart(pairs.select("x", "y")), "apart")
    size = edges.groupBy("key").agg(F.count(F.lit(1)).alias("others")).where("others > 1")
    loose = materialize(edges.join(apart, ["x", "y"], "left_semi").select("key").distinct().join(size, "key"), "loose")
    drop_table(apart, edges)
    if loose.isEmpty():
        drop_table(keys)
    else:
        marked = map_arrow(keyed, _marked_keys(join.share(bitmap(loose, "key"))), "key bigint, cid bigint")
        found = materialize(marked.join(loose, "key").distinct(), "found")
        drop_table(keys)
        asked = materialize(found.select("cid").distinct(), "asked")
        own = join.classes(asked)
        hashes = found.join(own.select("cid", "n"), "cid").groupBy("key").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
        member = materialize(found.join(hashes, "key"), "member")
        drop_table(asked, found)
        tested = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        large = member.where(F.col("others") >= LARGE)
        later = []
        for r in range(0 if large.isEmpty() else FOREST_ROUNDS):
            pick = large.groupBy("cid").agg(F.max_by("key", F.struct("others", "key") if r == 0 else F.xxhash64(F.lit(r), "key")).alias("key"))
            some = materialize(large.join(pick, ["cid", "key"], "left_semi"), "some")
            later.append(join.cross(some, own, tested, False))
            tested = tested.unionByName(later[-1])
            join.verify(materialize(later[-1], "asked_pairs"))
            drop_table(some)
        join.verify(join.cross(member, own, tested, True))
        drop_table(own, member, *later)
    drop_table(loose)


def jaccard_components(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """id_col, n_shingles, component_id for every row, and with links n_links: how many other rows it is linked with."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keys, keyed, edges = _candidates(docs, percent)
    sig = materialize(keys.select("id", "n", "cid", "sketch"), "lean")
    join = _Join(docs, sig, percent)

    pairs = materialize(edges.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")), "pairs")
    possible = join.possible(pairs)
    best = materialize(possible.groupBy("x").agg(F.max(F.struct("c", (-F.col("y")).alias("y"))).alias("b")).select("x", (-F.col("b.y")).alias("y")), "best")
    others = possible.select("x", "y").join(best, ["x", "y"], "left_anti")
    others = materialize(others, "others")
    join.verify(best)
    join.verify(materialize(join.apart(others), "rest"))
    drop_table(possible, others)
    _compare_loose(join, keys, keyed, edges, pairs)
    drop_table(pairs)

    first = sig.where("n > 0").groupBy("cid").agg(F.min("id").alias("first"))
    if join.links:
        label = components(join.all_links())
        first = first.join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    else:
        label = None
        first = first.withColumn("label", F.col("cid"))
    first = materialize(first, "first")
    name = first.groupBy("label").agg(F.min("first").alias("component_id"))
    named = first.join(name, "label").select("cid", "component_id")
    own = [F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")]
    if links:
        named = named.join(_all_links(join, first.select("cid", "label")), "cid")
        own.append(F.coalesce(F.col("m") - 1 + F.col("links"), F.lit(0)).alias("n_links"))
    out = materialize(sig.select("id", "n", "cid").join(named, "cid", "left").select(*own), "components")
    drop_table(sig, label, first)
    join.close()
    return out
