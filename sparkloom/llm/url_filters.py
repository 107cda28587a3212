"""URL filters by hashed host-suffix and path-prefix expressions, with DataFrame functions only.

Each distinct url is expanded into every suffix of its host (at label borders) joined with every
prefix of its path that has the length of some rule's path. The first four bytes of an expression's
SHA-256 are joined with those of the rules; the whole digest then confirms the match, so that hash
collisions never decide. Of the confirmed rules the longest wins, then the one with the longer host,
then block before allow.

Urls that are null or have no ``://`` have an empty host and path and fit no rule. Repeated rows are
judged alike and all kept. Only the id and url columns are read. Rules that are null or empty in host
are ignored. Where no rule fits, the verdict is ``default`` (allow).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are broadcast; more are joined by a shuffle on the hash prefix.
BROADCAST_RULES = 100_000
#: More different lengths of rule paths than this are refused, as each is an expression of every url.
MAX_PATH_LENGTHS = 2_000


def lower_ascii(c):
    return F.translate(c, _UPPER, _LOWER)


def split_url(url):
    """(host, path) columns: host up to / ? # with A-Z lower-cased; path from there up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _expression(host, path):
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)  # no host or path prefix is confused with another


def url_filters(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """rules: host, path, verdict. Returns id, host, path, rule, verdict for each row of pages."""
    rules = (
        rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("verdict").isNotNull())
        .select(lower_ascii(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
        .withColumn("digest", _expression(F.col("r_host"), F.col("r_path")))
    )
    known = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.length("r_path")).alias("lengths")).first()
    lengths = sorted(known["lengths"])
    if len(lengths) > MAX_PATH_LENGTHS:
        raise ValueError(f"{len(lengths)} different lengths of rule paths")
    rules = rules.withColumn("short", F.substring("digest", 1, 8))
    if known["n"] <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    host, path = split_url(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = rows.groupBy("id", "url").agg(F.count(F.lit(1)).alias("copies"))
    urls = urls.withColumn("host", host).withColumn("path", path)
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]).cast("array<string>"), lambda p: p.isNotNull())
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _expression(s, p))))
    spread = urls.withColumn("expression", F.explode_outer(expressions)).withColumn("short", F.substring("expression", 1, 8))
    hits = spread.join(rules, "short", "left")
    fits = F.col("expression") == F.col("digest")
    best = F.when(fits, F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")))
    judged = hits.groupBy("id", "url").agg(F.first("copies").alias("copies"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(best).alias("best"))
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
