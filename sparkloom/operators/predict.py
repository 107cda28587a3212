"""Importance, subjects, deadlines, follow-ups and resurfacing. ``now`` is always an argument."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import derive_subject, text_of
from ..functions.vectors import cosine

# Weights of the importance model.
WEIGHTS = {"sent_by_you": 1.6, "deadline": 2.0, "attachment": 1.2, "mentions_you": 2.4, "decision_language": 1.8, "substance": 1.0, "recency": 1.4, "inbound": 0.6}
# Cues.
RE_IMPORTANT = r"(?i)\b(decid[A-Za-z0-9_]*|agreed|sign(?:ed)?[\s-]?off|approv[A-Za-z0-9_]*|final[A-Za-z0-9_]*|ship[A-Za-z0-9_]*|launch[A-Za-z0-9_]*|deadline|due\s+(?:by|date)|by\s+(?:eod|end\s+of)|action item|owner|assign[A-Za-z0-9_]*|confirm[A-Za-z0-9_]*|blocker|outage|incident|escalat[A-Za-z0-9_]*|roll\s*back|post[\s-]?mortem|root cause)\b"
RE_QUESTION = r"(?i)^\s*(what|which|where|when|who|how|why|do you (?:have|know|see|have you)|did you|have you|can you (?:send|share|confirm|check|find)|could you (?:send|share|confirm|check)|is there|are there|any (?:idea|thoughts|chance)|thoughts\?|opinions\?|feedback\?)\b"
RE_ANSWER = r"(?i)^\s*(yes|no|yep|nope|sure|here(?:'s| is)|found it|answer|confirmed|approved|signed|re:|regarding)\b|https?://"
HARDNESS = {"hard": 1.0, "medium": 0.7, "soft": 0.35}

#: Recent documents that an old one is compared with at once.
ANCHOR_BLOCK = 256


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(text_of(c), r"\s+"), lambda w: w != ""))


def importance(docs: DataFrame, now: Column, self_refs: list[str] = (), text: str = "body_text", ts: str = "ts", sender: str = "sender_ref", deadlines: Column | None = None, attachments: Column | None = None, inbound: Column | None = None) -> DataFrame:
    """docs with importance (0 to 1) and its features: a linear model of what makes a message matter."""
    no = F.lit(False)
    body = F.col(text)
    handles = [r.split(":", 1)[1] for r in self_refs if ":" in r]
    mention = F.arrays_overlap(F.regexp_extract_all(text_of(body), F.lit(r"@([A-Za-z0-9_][A-Za-z0-9_.\-]*)"), F.lit(1)), F.array(*[F.lit(h) for h in handles])) if handles else no
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 86_400_000_000.0)
    flag = lambda name, c: F.when(F.coalesce(c, no), WEIGHTS[name]).otherwise(0.0)
    parts = {
        "sent_by_you": flag("sent_by_you", F.col(sender).isin(list(self_refs)) if self_refs else no),
        "deadline": flag("deadline", deadlines if deadlines is not None else no),
        "attachment": flag("attachment", attachments if attachments is not None else no),
        "mentions_you": flag("mentions_you", mention),
        "decision_language": flag("decision_language", body.rlike(RE_IMPORTANT)),
        "substance": F.when(body.isNotNull(), WEIGHTS["substance"] * F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0), word_count(body) - 20) / 180.0))).otherwise(0.0),
        "recency": F.coalesce(WEIGHTS["recency"] * F.pow(F.lit(0.5), age / 21.0), F.lit(0.0)),
        "inbound": flag("inbound", inbound if inbound is not None else no),
    }
    total = reduce(lambda a, b: a + b, parts.values())
    features = F.filter(F.array(*[F.struct(F.lit(n).alias("feature"), F.round(c, 2).alias("weight")) for n, c in parts.items()]), lambda x: x["weight"] != 0)
    return docs.withColumn("importance", F.least(F.lit(1.0), total / sum(WEIGHTS.values()))).withColumn("importance_features", features)


def thread_key(docs: DataFrame) -> Column:
    root = F.col("thread_root_id") if "thread_root_id" in docs.columns else F.lit(None).cast("string")
    return F.coalesce(F.nullif(root, F.lit("")), F.nullif(F.col("conversation_id"), F.lit("")), F.col("_id"))


def thread_subjects(docs: DataFrame, text: str = "body_text") -> DataFrame:
    """thread, subject: derived from the thread's root message, else its earliest."""
    t = thread_key(docs)
    first = docs.groupBy(t.cast("string").alias("thread")).agg(F.min_by(text, F.struct((F.col("_id").cast("string") != t.cast("string")).cast("int"), F.col("ts"), F.col("_id"))).alias("body"))
    return first.select("thread", derive_subject(F.col("body")).alias("subject"))


def deadline_predictions(deadlines: DataFrame, now: Column, horizon_days: int = 45) -> DataFrame:
    """Deadlines(_id, due timestamp, hardness, confidence, cue) still ahead, with days left and score."""
    ahead = deadlines.where((F.col("due") >= now) & (F.col("due") <= now + F.make_dt_interval(F.lit(horizon_days))))
    weight = F.when(F.col("hardness") == "hard", HARDNESS["hard"]).when(F.col("hardness") == "medium", HARDNESS["medium"]).when(F.col("hardness") == "soft", HARDNESS["soft"]).otherwise(0.5)
    days = F.floor((F.unix_micros(F.col("due").cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 86_400_000_000).cast("int")
    return ahead.withColumn("days", days).withColumn("score", weight / (1.0 + F.col("days") / 10.0) * F.coalesce("confidence", F.lit(0.6)))


def follow_ups(docs: DataFrame, now: Column, following: int = 2, text: str = "body_text") -> DataFrame:
    """_id, days, score of questions that enough later messages of their thread leave unanswered."""
    w = Window.partitionBy("_thread").orderBy("ts", "_id").rowsBetween(1, following + 1)
    rows = docs.where(F.col(text).isNotNull()).withColumn("_thread", thread_key(docs).cast("string"))
    rows = rows.withColumn("_next", F.collect_list(F.struct(F.col(text).alias("body"), F.col("_id").alias("id"))).over(w))
    open_ = rows.where(F.col(text).rlike(RE_QUESTION) & (F.size("_next") >= following) & ~F.exists("_next", lambda m: m["body"].rlike(RE_ANSWER)))
    days = F.greatest(F.lit(0), F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000)).cast("int")
    return open_.select("_id", F.col("_thread").alias("thread"), days.alias("days"), F.lit(0.65).alias("confidence"), F.transform("_next", lambda m: m["id"]).alias("followed_by")).withColumn("score", 0.5 + F.least(F.lit(0.35), F.col("days") / 200.0))


def resurfacing(vectors: DataFrame, recent: DataFrame, now: Column, dormant_days: int = 90, floor: float = 0.30, least_chars: int = 40) -> DataFrame:
    """_id, similarity, days, score of old documents (_id, ts, chars, vec) close to one of the recent ones (vec).

    Every recent document counts, however many; they come in blocks of about ``ANCHOR_BLOCK``, and the largest
    similarity of each block is all that is kept of it.
    """
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000).cast("int")
    old = vectors.withColumn("days", days).where((F.col("days") > dormant_days) & (F.col("chars") > least_chars))
    anchors = recent.select(F.col("vec").alias("anchor"))
    blocks = anchors.select(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / ANCHOR_BLOCK)).alias("blocks"))
    anchors = anchors.crossJoin(blocks).groupBy(F.pmod(F.xxhash64("anchor", F.monotonically_increasing_id()), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("anchor")).alias("anchors"))
    near = old.crossJoin(anchors.select("anchors")).select("_id", "days", F.array_max(F.transform("anchors", lambda a: cosine(F.col("vec"), a["anchor"]))).alias("similarity"))
    best = near.groupBy("_id", "days").agg(F.max("similarity").alias("similarity")).where(F.col("similarity") >= floor)
    return best.withColumn("score", F.col("similarity") * (1 + F.least(F.lit(0.5), F.col("days") / 400.0)))


def by_kind(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
