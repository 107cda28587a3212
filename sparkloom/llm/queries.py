"""The corpus operators' registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import read_table
from .idfiles import id_round_trip
from .jaccard import jaccard_components
from .language_id import fit, identify
from .mixing import mix_sources
from .packing import best_fit_pack
from .token_counts import token_counts
from .topk import topk
from .url_filters import url_filters
from .warc import warc_round_trip

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read_table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    learn = docs.where(~held).select(F.col("doc_id").alias("id"), "text", "lang")
    return identify(docs, fit(learn)).withColumn("held_out", F.coalesce(held, F.lit(False)))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), bpe_path())


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filters(read_table(spark, sf_dir, "pages"), rules)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), links=True)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).drop("finish")


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_round_trip(read_table(spark, sf_dir, "documents"), bpe_path())


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op10_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(read_table(spark, sf_dir, "documents"), bpe_path())


OP1_SQL = """
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s, n) AS first FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    (((strpos('0123456789abcdef', substr(s, 1 + 5 * k // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(s, 2 + 5 * k // 4, 1)) - 1) >> (3 - (5 * k) % 4)) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""

OP6_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM s GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 1 THEN 5e0 WHEN 2 THEN 2e0 ELSE 1e0 END AS w FROM src WHERE source_size > 0),
o AS (SELECT *, CAST(sum(3 * source_size) OVER (ORDER BY 3e0 * source_size / w, k ROWS UNBOUNDED PRECEDING) AS DOUBLE) - 3e0 * source_size AS before, sum(w) OVER (ORDER BY 3e0 * source_size / w DESC, k DESC ROWS UNBOUNDED PRECEDING) AS rest, (SELECT CAST(sum(source_size) AS DOUBLE) FROM w) AS total FROM w),
c AS (SELECT *, (total - before) * w / rest > 3 * source_size AS capped FROM o),
l AS (SELECT (SELECT CAST(sum(source_size) AS DOUBLE) FROM c) - coalesce(sum(3e0 * source_size) FILTER (capped), 0) AS rest, sum(w) FILTER (NOT capped) AS weight FROM c),
t AS (SELECT source, CASE WHEN capped THEN 3e0 * source_size ELSE l.rest * w / l.weight END AS target FROM c, l),
u AS (SELECT s.*, src.source_size, coalesce(t.target, 0) AS target, sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM s JOIN src ON s.source IS NOT DISTINCT FROM src.source LEFT JOIN t ON s.source IS NOT DISTINCT FROM t.source),
q AS (SELECT doc_id, size, (upto + e * source_size) / target AS finish FROM u, (VALUES (0), (1), (2)) AS v(e) WHERE target > 0 AND size > 0),
m AS (SELECT *, sum(size) OVER (ORDER BY finish RANGE UNBOUNDED PRECEDING) AS cum, (SELECT sum(target) FROM t) AS budget FROM q),
x AS (SELECT min((finish, cum - size / 2e0 <= budget)) AS line FROM m WHERE cum >= budget - 0.5e0)
SELECT doc_id, source, size, source_size, target, size * CAST(copies AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies
FROM (SELECT u.*, CASE WHEN target > 0 AND size > 0 THEN CAST((upto / target) < line[1] OR (upto / target = line[1] AND line[2]) AS INTEGER) + CAST(((upto + source_size) / target) < line[1] OR ((upto + source_size) / target = line[1] AND line[2]) AS INTEGER) + CAST(((upto + 2 * source_size) / target) < line[1] OR ((upto + 2 * source_size) / target = line[1] AND line[2]) AS INTEGER) ELSE 0 END AS copies FROM u LEFT JOIN x ON true)
"""

OP4_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(h, s, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT p.n, h || s AS rule, v, row_number() OVER (PARTITION BY p.n ORDER BY length(h || s) DESC, length(h) DESC) AS k
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.s)
)
SELECT p.page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m ON p.n = m.n AND m.k = 1
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

QUERIES = {f.__name__: f for f in (op1_warc, op2_language_id, op3_token_counts, op4_url_filters, op5_jaccard_join, op6_mix_sources, op7_id_files, op8_topk, op9_nearest, op10_best_fit_pack)}
ORACLES = {"op1_warc": OP1_SQL, "op6_mix_sources": OP6_SQL, "op4_url_filters": OP4_SQL, "op8_topk": OP8_SQL}
