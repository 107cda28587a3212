"""Mixing sources to target weights by weighted fair queueing.

Every source has a target number of words: its weight's share of the total, but at most ``max_epochs``
times what it has, the excess going to the other sources by weight (water-filling). A source offers
its documents in up to ``max_epochs`` shuffled passes. The virtual finish time of an offered copy is
the number of its source's words up to and including it, divided by the source's target; all copies
are merged by finish time and taken until the total budget is reached.

The order within a source is a seeded hash of the id, so reruns agree. Running sums never gather a
source in one task: documents are dealt by (source, range of the hash) and summed there, ranges are
summed by (source, group of ranges), groups by source. Documents that agree in source, id and size are
interchangeable: they are one row with a count until the end, so that no number of null or repeated
ids makes a range large. The merged order is cut into slots of finish time; the slot that the budget
ends in is found from the slots' words by narrowing groups of at most ``FAN`` sums, and only that slot
is ordered. The copies of the finish time that crosses the budget are taken if at least half of each
fits.

Null or empty texts have size 0 and are never taken. The null source is a source of its own, last in
order. Repeated rows are documents of their own; ties of the hash break by id, then by size; equal
finish times share one decision. Columns besides id, source and text are not read.
"""

from __future__ import annotations

import dataclasses
import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize

#: The sources' own table comes to the driver; more sources than this are refused.
MAX_SOURCES = 1_000_000
#: Sources whose cuts (a row each) are broadcast; with more, documents are joined with them by source.
BROADCAST_SOURCES = 20_000
#: Aimed-for documents in one (source, range) group; ranges in one group of ranges, and sums that the driver reads at once.
GROUP_ROWS, FAN = 1_000, 4_096
WORD = r"[^\x20\x09-\x0D]+"


def fill(sizes: list[int], weights: list[float], max_epochs: int) -> list[float]:
    """Targets by weight of sum(sizes), none above max_epochs times its size."""
    total, n = float(sum(sizes)), len(sizes)
    target, free, left = [0.0] * n, {i for i in range(n) if sizes[i] > 0}, total
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / w > max_epochs * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(max_epochs * sizes[i])
        left -= sum(target[i] for i in over)
        free -= over
    return target


def targets(sized: DataFrame, weights: tuple[float, ...], max_epochs: int) -> tuple[DataFrame, int, int]:
    """(key, source_size, target of each source; the number of ranges to deal documents to; that of sources). Weights go by code point, null last."""
    spark = sized.sparkSession
    stats = sized.groupBy("key").agg(F.sum(F.col("size") * F.col("rows")).alias("size"), F.sum("rows").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(stats) > MAX_SOURCES:
        raise ValueError("too many sources")
    stats.sort(key=lambda r: (r["key"] == "", r["key"]))  # Python compares by code point; the null source's key is empty
    w = [weights[i % len(weights)] for i in range(len(stats))]
    got = fill([r["size"] for r in stats], w, max_epochs)
    ranges = 1 << math.ceil(math.log2(max(1.0, sum(r["n"] for r in stats) / GROUP_ROWS)))
    rows = [(r["key"], int(r["size"]), t) for r, t in zip(stats, got, strict=True)]
    return spark.createDataFrame(rows, "key string, source_size bigint, target double"), ranges, len(stats)


def _offsets(placed: DataFrame) -> DataFrame:
    """key, bucket, before: the source's words in all ranges before, summed by groups of FAN ranges first."""
    before = lambda by, order: F.sum("words").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    sums = placed.groupBy("key", "bucket").agg(F.sum(F.col("size") * F.col("rows")).alias("words")).withColumn("group", F.floor(F.col("bucket") / FAN))
    sums = materialize(sums, "sums")
    groups = sums.groupBy("key", "group").agg(F.sum("words").alias("words"))
    groups = groups.select("key", "group", before(["key"], "group").alias("group_before"))
    return sums.withColumn("before", before(["key", "group"], "bucket")).join(groups, ["key", "group"]).select("key", "bucket", (F.col("before") + F.col("group_before")).alias("before"))


def _line(queue: DataFrame, budget: float) -> float:
    """The last finish time whose copies are taken; queue has size, finish and slot (ascending with finish)."""
    sums = materialize(queue.groupBy("slot").agg(F.sum("size").alias("words")), "slots")
    low, high = sums.agg(F.min("slot"), F.max("slot")).first()
    if low is None:
        return -1.0
    spent, width = 0, high - low + 1
    while True:
        step = -(-width // FAN)
        part = F.floor((F.col("slot") - low) / step)
        for r in sorted(sums.where(F.col("slot").between(low, low + width - 1)).groupBy(part.alias("part")).agg(F.sum("words").alias("words")).collect()):
            if spent + r["words"] >= budget - 0.5:
                low, width = low + r["part"] * step, step
                break
            spent += r["words"]
        else:
            return math.inf  # all copies together are less than the budget
        if width == 1:
            break
    drop_table(sums)
    order = Window.partitionBy("slot").orderBy("finish").rangeBetween(Window.unboundedPreceding, 0)
    inside = queue.where(F.col("slot") == low).withColumn("sum", F.sum("size").over(order))
    # of equal finish times the smallest copy has the most of it beyond the budget
    crossing = inside.where(F.col("sum") + spent >= budget - 0.5).agg(F.min(F.struct("finish", (F.col("size") / 2 - F.col("sum")).alias("half")))).first()[0]
    return crossing["finish"] if spent - crossing["half"] <= budget else math.nextafter(crossing["finish"], -1.0)


def _hash(id_, seed: int):
    """The first 60 bits of a digest of the id, which SQL elsewhere can compute too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _key(source):
    """A source's key; null has one of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _size(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


@dataclasses.dataclass
class _Mix:
    run: DataFrame  # written: key, h, id, size, rows, nth, upto, source_size, target of every document
    sources: int
    line: float  # the last finish time that is taken
    epochs: int

    def finish(self, epoch: int):
        return F.when((F.col("target") > 0) & (F.col("size") > 0), (F.col("upto") + epoch * F.col("source_size")) / F.col("target"))


def _queued(docs: DataFrame, weights: tuple[float, ...], max_epochs: int, seed: int, id_col: str, text_col: str, source_col: str) -> _Mix:
    c = lambda name: F.col(f"`{name}`")
    sized = docs.select(c(id_col).alias("id"), _key(c(source_col)).alias("key"), _size(c(text_col)).alias("size")).groupBy("key", "id", "size").agg(F.count(F.lit(1)).alias("rows"))
    sized = materialize(sized, "sized")
    plan, ranges, sources = targets(sized, weights, max_epochs)
    bits = ranges.bit_length() - 1
    placed = sized.withColumn("h", _hash(F.col("id"), seed)).withColumn("bucket", F.shiftrightunsigned("h", 60 - bits) if bits else F.lit(0).cast("bigint"))
    order = Window.partitionBy("key", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    within = F.sum(F.col("size") * F.col("rows")).over(order) - F.col("size") * F.col("rows")
    run = placed.withColumn("within", within).join(_offsets(placed), ["key", "bucket"]).join(plan, "key")
    run = run.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), "rows"))).withColumn("upto", F.col("before") + F.col("within") + F.col("nth") * F.col("size"))
    run = materialize(run.select("key", "h", "id", "size", "rows", "nth", "upto", "source_size", "target"), "run")
    drop_table(sized)
    mix = _Mix(run, sources, -1.0, max_epochs)
    # slots of equal width up to twice the time that all targets take, where the budget ends unless documents are larger
    # than targets, and of growing width beyond
    slot = F.when(F.col("finish") < 2, F.floor(F.col("finish") * ranges)).otherwise(F.floor(ranges * (F.log2("finish") + 1)))
    queue = run.select("size", F.explode(F.array(*map(mix.finish, range(max_epochs)))).alias("finish")).where("finish is not null").withColumn("slot", slot.cast("bigint"))
    mix.line = _line(queue, plan.agg(F.sum("target")).first()[0] or 0.0)
    return mix


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source, source_size, target, taken (words), copies, finish (of the first copy)."""
    mix = _queued(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    source = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias(source_col)
    copies = sum((F.when(mix.finish(e) <= mix.line, 1).otherwise(0) for e in range(max_epochs)), F.lit(0))
    return mix.run.select(F.col("id").alias(id_col), source, "size", "source_size", "target", (copies * F.col("size")).cast("bigint").alias("taken"), copies.cast("int").alias("copies"), mix.finish(0).alias("finish"))


def mixed_rows(docs: DataFrame, id_col: str, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes each; the same decisions as mix_sources'.

    In each pass a source's documents are taken up to one place of its order, so that a row for each source
    says what is taken, and texts are not shuffled. Only documents that agree with the one at that place
    in source, id and size are counted, where there are several.
    """
    mix = _queued(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    taken = [f"cut{e}" for e in range(max_epochs)]
    place = F.struct("h", "id", "size")
    cuts = mix.run.groupBy("key").agg(*(F.max(F.when(mix.finish(e) <= mix.line, F.struct(place.alias("place"), "nth", "rows"))).alias(c) for e, c in enumerate(taken)))
    cuts = materialize(cuts, "cuts")
    drop_table(mix.run)
    row, own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), lambda c: F.col("row").getField(c)
    rows = docs.select(row.alias("row")).select("row", _key(own(source_col)).alias("key"), F.struct(_hash(own(id_col), seed).alias("h"), own(id_col).alias("id"), _size(own(text_col)).alias("size")).alias("place"))
    rows = rows.where("place.size > 0").join(F.broadcast(cuts) if mix.sources <= BROADCAST_SOURCES else cuts, "key")
    several = lambda c: (F.col("place") == F.col(f"{c}.place")) & (F.col(f"{c}.rows") > 1)
    at_cut = F.coalesce(functools.reduce(lambda x, y: x | y, [F.coalesce(several(c), F.lit(False)) for c in taken]), F.lit(False))

    def copied(rows, nth):
        within = [F.coalesce((F.col("place") < F.col(f"{c}.place")) | ((F.col("place") == F.col(f"{c}.place")) & (nth <= F.col(f"{c}.nth"))), F.lit(False)).cast("int") for c in taken]
        copies = functools.reduce(lambda x, y: x + y, within)
        return rows.withColumn("copies", copies).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

    counted = functools.reduce(lambda x, y: x | y, [F.coalesce(F.col(f"{c}.rows") > 1, F.lit(False)) for c in taken])
    if cuts.where(counted).isEmpty():
        return copied(rows, F.lit(1))
    nth = F.row_number().over(Window.partitionBy("key", "place").orderBy(F.xxhash64(*_hashable(rows.schema["row"].dataType, "row"))))
    return copied(rows.where(~at_cut), F.lit(1)).unionByName(copied(rows.where(at_cut).withColumn("nth", nth), F.col("nth")))


def _hashable(kind, at: str):
    """The fields of a struct column as columns that xxhash64 takes; those with maps as JSON."""
    return [F.to_json(F.struct(F.col(at).getField(f.name))) if "map<" in f.dataType.simpleString() else F.col(at).getField(f.name) for f in kind.fields]
