"""Batch detectors over interactions, documents, files and persons. ``now`` is always an argument."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import RE_DECISION, RE_REJECTION, decision_signature, sentences
from ..storage import materialize
from . import blocks as B

INSIGHT = "struct<detector:string,title:string,entities:array<string>,confidence:double,evidence:array<string>>"


def participants(docs: DataFrame, group: str = "conversation_id", ref: str = "sender_ref") -> DataFrame:
    """group, participants: the most active first, then by name."""
    n = docs.where(F.col(ref).isNotNull() & F.col(group).isNotNull()).groupBy(group, ref).agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(ref).alias("ref"))))
    return n.groupBy(group).agg(F.transform(ordered, lambda x: x["ref"]).alias("participants"))


def interactions(docs: DataFrame, group: str = "conversation_id", ref: str = "sender_ref", ts: str = "ts", key: str = "_id") -> DataFrame:
    """a < b, ts, key: each message meets every other participant of its conversation once."""
    rows = docs.where(F.col(ref).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(ref).alias("r"), F.col(ts).alias("ts"), F.col(key).alias("key"))
    others = rows.select("g", F.col("r").alias("o")).distinct()
    return rows.join(others, "g").where("r <> o").select(F.least("r", "o").alias("a"), F.greatest("r", "o").alias("b"), "ts", "key")


def meetings(docs: DataFrame, group: str = "conversation_id", ref: str = "sender_ref", ts: str = "ts", key: str = "_id", last: bool = True, least: int = 1, blocks: bool | None = None) -> DataFrame:
    """a < b, n, and unless left out the last time: how often the pairs of interactions() meet, if so often at least.

    Interactions with one pair, time and key count once. They are not made one by one: what a pair has from a group
    follows from how many messages each of both wrote there and when the last one was. Only messages whose time
    and key others have too are compared as such. With blocks, or if these pay, pairs are counted in tables of a
    fixed size (see blocks.py), else by a join.
    """
    rows = docs.where(F.col(ref).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(ref).alias("r"), F.col(ts).cast("timestamp").alias("ts"), F.col(key).alias("key"))
    who = rows.groupBy("ts", "key").agg(F.collect_set(F.struct("g", "r")).alias("who")).withColumn("one", F.size("who") == 1)
    who = who.select("ts", "key", "one", F.explode("who").alias("w")).select("w.g", "w.r", "ts", "key", "one")
    at = F.coalesce(F.max(F.when(F.col("one"), F.unix_micros("ts"))), F.lit(B.NONE))
    part = materialize(who.groupBy("g", "r").agg(F.count_if("one").alias("c"), at.alias("last"), F.count_if(~F.col("one")).alias("shared")), "part")
    members, count, pairs = B.sizes(part)
    some = part.where("shared > 0").limit(1).count() > 0
    merge, floor = some, 1 if some else least
    if B.pays(members, count, pairs) if blocks is None else blocks:
        out, several = B.meeting_counts(part, members, count, last, floor)
        merge |= several
    else:
        a, b = (part.select("g", F.col("r").alias(x), F.col("c").alias(f"c{x}"), F.col("last").alias(f"l{x}")) for x in "ab")
        met = a.join(b, "g").where("a < b").groupBy("a", "b")
        out = met.agg(F.sum(F.expr("ca + cb")).alias("n"), *([F.max(F.greatest("la", "lb")).alias("last")] if last else [])).where("n > 0")
    if some:
        copies = who.where(~F.col("one")).join(part.select("g", F.col("r").alias("o")), "g").where("r <> o")
        copies = copies.select(F.least("r", "o").alias("a"), F.greatest("r", "o").alias("b"), "ts", "key").distinct().groupBy("a", "b")
        out = out.unionByName(copies.agg(F.count(F.lit(1)).alias("n"), *([F.coalesce(F.max(F.unix_micros("ts")), F.lit(B.NONE)).alias("last")] if last else [])))
    if merge:
        out = out.groupBy("a", "b").agg(F.sum("n").alias("n"), *([F.max("last").alias("last")] if last else []))
    out = out.where(F.col("n") >= least)
    return out.withColumn("last", F.when(F.col("last") > B.NONE, F.timestamp_micros("last"))) if last else out


def interaction_stats(pairs: DataFrame) -> DataFrame:
    """pairs, interactions, most of interactions(), or of meetings()."""
    counted = pairs if "n" in pairs.columns else pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("interactions"), F.max("n").alias("most"))


def _stopped(met: DataFrame, now: Column, days: int, least: int) -> DataFrame:
    met = met.where((F.col("n") >= least) & (F.col("last") <= now - F.make_dt_interval(F.lit(days))))
    return met.withColumn("confidence", F.least(F.lit(0.9), 0.45 + 0.05 * F.col("n")))


def dormant_meetings(met: DataFrame, now: Column, days: int = 90, least: int = 4) -> DataFrame:
    """a, b, n, last, confidence of dormant(), from meetings()."""
    return _stopped(met, now, days, least).select("a", "b", "n", "last", "confidence")


def dormant(pairs: DataFrame, now: Column, days: int = 90, least: int = 4) -> DataFrame:
    """a, b, n, last, confidence, evidence (last three times) of pairs that used to meet and stopped."""
    out = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.array_sort(F.collect_list("ts")).alias("all"))
    return _stopped(out, now, days, least).select("a", "b", "n", "last", "confidence", F.slice("all", -3, 3).alias("evidence"))


def bursts(rows: DataFrame, keys: list[str], ts: str = "ts", tie: str = "key", days: int = 14, threshold: int = 8) -> DataFrame:
    """keys, start, end, n: the earliest window of that many interactions within those days.

    The window spans exactly ``threshold`` rows when it first qualifies, so a lag finds it.
    """
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    back = rows.withColumn("start", F.lag(ts, threshold - 1).over(w)).where((F.col(ts) - F.col("start")) <= F.make_dt_interval(F.lit(days)))
    first = back.groupBy(*keys).agg(F.min(F.struct(F.col(ts).alias("end"), F.col("start"))).alias("w"))
    return first.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.lit(threshold).alias("n"), F.lit(min(0.85, 0.4 + 0.03 * threshold)).alias("confidence"))


#: Shared contacts from which on the confidence is the same.
SURE = 4


def hidden_introducers(pairs: DataFrame, least: int = 2, evidence: bool = True, blocks: bool | None = None, ends: DataFrame | None = None, counts: bool = True) -> DataFrame:
    """a, b, mutual, confidence, evidence (the third and last unless left out) of pairs of interactions() or meetings() that never met but share contacts.

    With ends(id), only pairs of these. Sparse contacts are joined at their hubs; with blocks, or if these take less, shared contacts
    are counted by products of tiles.
    """
    edge = pairs.select("a", "b")
    edge = materialize(edge if "n" in pairs.columns else edge.distinct(), "met")  # read several times below
    link = edge.select(F.explode(F.array(F.struct(F.col("a").alias("hub"), F.col("b").alias("x")), F.struct(F.col("b").alias("hub"), F.col("a").alias("x")))).alias("e")).select("e.*")
    if blocks is None:
        n = link.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.sum(F.expr("double(n) * (n - 1) / 2"))).first()
        blocks = B.dense(n[0], int(n[1] or 0))
    if blocks:
        out = B.unlinked_pairs(B.tiles_of_edges(edge), least, 5 if evidence else 0, ends, None if counts else max(SURE, least))
    else:
        if ends is not None:
            link = link.join(ends.toDF("x"), "x", "left_semi")
        # the few bytes of links grow to their squares per hub: dealt by number, which is not undone for being small
        link = link.repartition(int(edge.sparkSession.conf.get("spark.sql.shuffle.partitions")), "hub")
        meet = link.select("hub", F.col("x").alias("a")).join(link.select("hub", F.col("x").alias("b")), "hub").where("a < b")
        shared = [F.slice(F.array_sort(F.collect_list("hub")), 1, 5).alias("evidence")] if evidence else []
        found = meet.groupBy("a", "b").agg(F.count(F.lit(1)).alias("mutual"), *shared).where(F.col("mutual") >= least)
        out = found.join(edge, ["a", "b"], "left_anti")
    return _introduced(out, evidence, counts)


def _introduced(found: DataFrame, evidence: bool, counts: bool) -> DataFrame:
    sure = F.least(F.lit(0.55), 0.2 + 0.1 * F.col("mutual")).alias("confidence")
    return found.select("a", "b", *(["mutual"] if counts else []), sure, *(["evidence"] if evidence else []))


def hidden_in_groups(docs: DataFrame, group: str = "conversation_id", ref: str = "sender_ref", least: int = 2, evidence: bool = True, blocks: bool | None = None, ends: DataFrame | None = None, counts: bool = True) -> DataFrame:
    """hidden_introducers() of those who share a group. Where contacts may be dense (or with blocks), who met whom is kept as bits only."""
    rows = docs.where(F.col(ref).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(ref).alias("r")).distinct()
    rows = materialize(rows, "groups")
    members, count, pairs = B.sizes(rows)
    each = min(2 * pairs / max(1, members), members)  # contacts of a member at most, on average
    if blocks or blocks is None and members and (B.pays(members, count, pairs) or B.dense(members, int(members * each * each / 2))):
        tiles = B.tiles_of_groups(rows, members, count)
        if blocks or B.dense(members, tiles.paths()):
            return _introduced(B.unlinked_pairs(tiles, least, 5 if evidence else 0, ends, None if counts else max(SURE, least)), evidence, counts)
        met = B.linked_pairs(tiles).withColumn("n", F.lit(1))
    else:
        a, b = (rows.select("g", F.col("r").alias(x)) for x in "ab")
        met = a.join(b, "g").where("a < b").select("a", "b")
    return hidden_introducers(met, least, evidence, blocks, ends, counts)


def single_source(persons: DataFrame, least: int = 5) -> DataFrame:
    return persons.where((F.size("providers") == 1) & (F.col("message_count") >= least)).select("person_id", F.get("providers", F.lit(0)).alias("provider"), "message_count", F.lit(0.4).alias("confidence"))


def decision_divergence(docs: DataFrame, text: str = "body_text", provider: str = "provider", key: str = "_id", overlap: int = 3) -> DataFrame:
    """signature, providers, accepts, rejects, confidence of topics decided one way here and another way there."""
    s = docs.select(F.col(key).alias("key"), F.col(provider).alias("provider"), F.explode(sentences(F.col(text))).alias("s"))
    s = s.withColumn("accept", F.col("s").rlike(RE_DECISION)).withColumn("reject", F.col("s").rlike(RE_REJECTION)).where("accept or reject")
    s = s.withColumn("signature", decision_signature(F.col("s"))).where(F.size("signature") >= overlap)
    g = s.groupBy(F.array_join("signature", " ").alias("signature")).agg(F.countDistinct("provider").alias("providers"), F.count_if("accept").alias("accepts"), F.count_if("reject").alias("rejects"))
    return g.where("providers >= 2 and accepts > 0 and rejects > 0").withColumn("confidence", F.lit(0.7))


def file_references(attachments: DataFrame, file_id: str) -> DataFrame:
    return attachments.groupBy(file_id).agg(F.count(F.lit(1)).alias("references"))


# Providers whose accounts count as owners that should be known.
OWNER_PROVIDERS = ("slack", "gmail", "whatsapp", "gdrive")


def orphan_files(files: DataFrame, references: DataFrame, known_refs: DataFrame, file_id: str = "provider_file_id", owner: str = "owner_ref", providers: tuple[str, ...] | None = OWNER_PROVIDERS) -> DataFrame:
    """Referenced files without an owner, or whose owner, an account of one of the providers (of any for None), is nobody we know."""
    rows = files.join(references, file_id)
    if providers is not None:
        rows = rows.where((F.coalesce(F.col(owner), F.lit("")) == "") | F.substring_index(owner, ":", 1).isin(*providers) & F.col(owner).contains(":"))
    unowned = F.coalesce(F.col(owner), F.lit("")) == ""
    known = known_refs.select(F.col("ref").alias(owner)).distinct()
    return rows.where(unowned).unionByName(rows.where(~unowned).join(known, owner, "left_anti").select(*rows.columns)).withColumn("confidence", F.lit(0.55))


def as_insight(df: DataFrame, detector: str, title: Column, entities: Column, evidence: Column | None = None) -> DataFrame:
    """The common shape; the id is a hash of content, so that reruns agree and reviews stay attached."""
    evidence = F.array().cast("array<string>") if evidence is None else evidence.cast("array<string>")
    rows = df.select(F.lit(detector).alias("detector"), title.alias("title"), entities.cast("array<string>").alias("entities"), F.col("confidence"), F.slice(evidence, 1, 5).alias("evidence"))
    return rows.withColumn("insight_id", F.concat(F.lit("ins_"), F.substring(F.sha2(F.concat_ws("|", "detector", F.array_join("entities", ","), "title"), 256), 1, 24)))


def run_all(pairs: DataFrame, docs: DataFrame, persons: DataFrame, files: DataFrame, references: DataFrame, known_refs: DataFrame, now: Column) -> DataFrame:
    """All detectors, strongest first."""
    two = F.array("a", "b")
    parts = [
        as_insight(dormant(pairs, now), "dormant", F.format_string("%s and %s stopped talking", "a", "b"), two, F.col("evidence")),
        as_insight(bursts(pairs, ["a", "b"]), "burst", F.format_string("%s and %s met often", "a", "b"), two),
        as_insight(hidden_introducers(pairs), "hidden_introducer", F.format_string("%s and %s share contacts", "a", "b"), two, F.col("evidence")),
        as_insight(single_source(persons), "single_source", F.format_string("%s is known from %s only", "person_id", "provider"), F.array("person_id")),
        as_insight(decision_divergence(docs), "decision_divergence", F.col("signature"), F.array("signature")),
        as_insight(orphan_files(files, references, known_refs), "orphan_file", F.col("name"), F.array("_id")),
    ]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("confidence"), "detector", "title")


def by_detector(insights: DataFrame) -> DataFrame:
    return insights.groupBy("detector").agg(F.count(F.lit(1)).alias("n"))
