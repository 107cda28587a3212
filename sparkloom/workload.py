"""Registered queries over the star schema and the corpus tables, each with SQL that DuckDB runs alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, privacy, text, vectors
from .functions.text import SIGNATURE_EXTRA, SIGNATURE_STOPWORDS, STOPWORDS, SUFFIXES
from .operators import documents as D
from .operators import graph as G
from .operators import identity as I
from .operators import insights as N
from .operators import predict as P
from .operators import search as S
from .operators import summarize as Z
from .plans.compiler import compile_question, execute
from .storage import shared_dir
from .streaming import ingest as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its zoneless times read as UTC."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    zoneless = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def stem_sql(w: str) -> str:
    rules = " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) - {len(s)} >= 3 THEN substr({w}, 1, length({w}) - {len(s)}) || '{r}'" for s, r in SUFFIXES)
    return f"CASE WHEN length({w}) <= 3 OR regexp_matches({w}, '^[0-9]+$') THEN {w} {rules} ELSE {w} END"


def tokens_sql(t: str, stop: bool = False) -> str:
    words = f"list_filter(list_transform(regexp_extract_all(lower(coalesce({t}, '')), '[A-Za-z0-9_@.''+-]+'), lambda x: trim(x, '.''-')), lambda x: length(x) >= 2{f' AND x NOT IN ({quoted(STOPWORDS)})' if stop else ''})"
    return f"list_transform({words}, lambda w: {stem_sql('w')})"


# --- search ---------------------------------------------------------------------------------------

TERMS = ["the", "and", "that"]


def bm25_sql(source: str, fields: dict[str, tuple[str, float]], terms: list[str], key: str, more: str = "") -> str:
    """Field-weighted BM25 as SQL; leaves the CTE scores(doc_id, score)."""
    unpivot = " UNION ALL ".join(f"SELECT {key} AS doc_id, '{n}' AS field, {w}e0 AS weight, {tokens_sql(c)} AS tokens FROM {source}" for n, (c, w) in fields.items())
    return f"""WITH f AS ({unpivot}), p AS (SELECT doc_id, field, weight, unnest(tokens) AS term FROM f),
    tf AS (SELECT doc_id, field, weight, term, count(*) AS tf FROM p WHERE term IN ({quoted(terms)}) GROUP BY ALL),
    df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tf GROUP BY term),
    docs AS (SELECT count(*) AS n FROM {source}),
    av AS (SELECT field, sum(len(tokens)) / (SELECT n FROM docs) AS a FROM f GROUP BY field),
    scores AS (SELECT tf.doc_id, sum(greatest(0.05e0, ln(1 + (docs.n - df + 0.5e0) / (df + 0.5e0))) * tf.weight * tf.tf * 2.5e0 / (tf.tf + 1.5e0 * (0.25e0 + 0.75e0 * len(f.tokens) / CASE WHEN a > 0 THEN a ELSE 1 END))) AS score
      FROM tf JOIN df USING (term) JOIN f ON f.doc_id = tf.doc_id AND f.field = tf.field JOIN av ON av.field = tf.field CROSS JOIN docs GROUP BY tf.doc_id){more}"""


def document_index(spark, sf_dir) -> S.Index:
    return S.build_index(table(spark, sf_dir, "documents"), "doc_id", {"body": F.col("text")})


PAGE_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
PAGE_FIELDS = {"title": (f"regexp_extract(html, '{PAGE_TITLE}', 1)", 3.0), "provider": ("regexp_extract(url, '://([^/]+)', 1)", 0.8)}


def page_index(spark, sf_dir) -> S.Index:
    fields = {"title": F.regexp_extract("html", PAGE_TITLE, 1), "provider": F.regexp_extract("url", "://([^/]+)", 1)}
    return S.build_index(table(spark, sf_dir, "pages"), "page_id", fields)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(bm25_sql("documents", {"body": ("text", 1.0)}, TERMS, "doc_id") + " SELECT doc_id, round(score, 6) AS score FROM scores ORDER BY scores.score DESC, doc_id LIMIT 20")
def bm25_top20(spark, sf_dir):
    return rounded(S.top(S.bm25(document_index(spark, sf_dir), TERMS), 20), "score")


@query(bm25_sql("pages", PAGE_FIELDS, ["the", "blog"], "page_id") + " SELECT doc_id, round(score, 6) AS score FROM scores")
def bm25_fielded(spark, sf_dir):
    return rounded(S.bm25(page_index(spark, sf_dir), ["the", "blog"]), "score")


@query(f"""SELECT (SELECT count(*) FROM documents) AS docs, count(DISTINCT term) AS terms, count(*) AS postings, round(count(*) / (SELECT count(*) FROM documents), 2) AS terms_per_doc
FROM (SELECT DISTINCT doc_id, unnest({tokens_sql("text")}) AS term FROM documents)""")
def index_stats(spark, sf_dir):
    return document_index(spark, sf_dir).stats()


@query(f"""SELECT count(*) FILTER (n >= 2) AS kept, count(*) FILTER (n < 2) AS dropped FROM (SELECT term, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest({tokens_sql("text")}) AS term FROM documents) GROUP BY term)""")
def index_k_anonymous(spark, sf_dir):
    return S.k_anonymous(document_index(spark, sf_dir), 2)[1]


@query(f"SELECT conv_id, turn, {tokens_sql('text', True)} AS tokens FROM conversations")
def tokenize_terms(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.tokenize("text", keep_stopwords=False).alias("tokens"))


@query(f"""SELECT term, count(*) AS df, round(greatest(0.05e0, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5e0) / (count(*) + 0.5e0))), 6) AS idf
FROM (SELECT DISTINCT doc_id, unnest({tokens_sql("text")}) AS term FROM documents) GROUP BY term""")
def term_df_idf(spark, sf_dir):
    index = document_index(spark, sf_dir)
    n = index.documents.agg(F.count(F.lit(1)).alias("docs"))
    return index.document_frequency().crossJoin(F.broadcast(n)).select("term", "df", F.round(S.idf(F.col("docs"), F.col("df")), 6).alias("idf"))


@query(f"SELECT DISTINCT unnest({tokens_sql('text')}) AS term FROM documents WHERE doc_id = 17")
def index_terms_for(spark, sf_dir):
    return document_index(spark, sf_dir).terms_for(17)


FACET_SQL = """SELECT facet, value, count(*) AS n FROM (
 SELECT 'provider' AS facet, source AS value FROM h UNION ALL SELECT 'kind', lang FROM h UNION ALL SELECT 'with_files', 'true' FROM h WHERE quality = 1 UNION ALL
 SELECT 'year', substr(ts, 1, 4) FROM h WHERE regexp_matches(substr(ts, 1, 4), '^[0-9]{4}$')) WHERE value IS NOT NULL GROUP BY ALL"""


@query(
    bm25_sql("documents", {"body": ("text", 1.0)}, TERMS, "doc_id")
    + """, h AS (SELECT s.doc_id, d.source, d.lang, l.quality, CAST(2000 + d.doc_id % 5 AS VARCHAR) AS ts FROM scores s JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND d.source IN ('src1', 'src2', 'src3')) """
    + FACET_SQL
)
def search_filtered_facets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    allowed = D.matching(docs, [D.Filter("lang", "eq", "en"), D.Filter("source", "in", ["src1", "src2", "src3"])]).select("doc_id")
    hits = S.bm25(document_index(spark, sf_dir), TERMS, allowed)
    shown = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.col("source").alias("provider"), F.col("lang").alias("kind"), (F.col("quality") == 1).alias("has_attachment"), (2000 + F.col("doc_id") % 5).cast("string").alias("ts"))
    return S.result_facets(hits.join(shown, "doc_id"))


@query(
    bm25_sql("pages", PAGE_FIELDS, ["the"], "page_id")
    + f" SELECT doc_id, round(score * CASE WHEN contains(lower({PAGE_FIELDS['title'][0]}), 'the') THEN 2.5e0 ELSE 1e0 END, 6) AS score FROM scores JOIN pages ON page_id = doc_id"
)
def search_phrase_boost(spark, sf_dir):
    return rounded(S.bm25(page_index(spark, sf_dir), ["the"], phrases=["the"]), "score")


@query(bm25_sql("pages", PAGE_FIELDS, ["the"], "page_id") + f" SELECT doc_id, round(score, 6) AS score FROM scores JOIN pages ON page_id = doc_id WHERE NOT contains(lower({PAGE_FIELDS['title'][0]}), 'ing')")
def search_exclude(spark, sf_dir):
    return rounded(S.bm25(page_index(spark, sf_dir), ["the"], exclude=["ing"]), "score")


@query(
    bm25_sql("documents", {"body": ("text", 1.0)}, TERMS, "doc_id")
    + ", w AS (SELECT * FROM scores ORDER BY score DESC, doc_id LIMIT 500) SELECT doc_id, round(score, 6) AS score, (SELECT count(*) FROM w) AS total, (SELECT count(*) FROM w) < 500 AS total_is_exact FROM (SELECT * FROM w ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10)"
)
def search_page_total(spark, sf_dir):
    rows, total = S.page(S.bm25(document_index(spark, sf_dir), TERMS), limit=10, offset=10)
    return rounded(rows.crossJoin(total), "score")


COSINE_SQL = "WITH q AS (SELECT embedding AS vec FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.vec AS DOUBLE[])) AS score FROM embeddings, q)"


def cosine_scores(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return S.similar(v, v.where("vec_id = 0").select(F.col("embedding").alias("vec")), "vec_id", "embedding")


@query(COSINE_SQL + " SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 5) WHERE score > 0.05")
def vector_topk_cosine(spark, sf_dir):
    return rounded(S.top(cosine_scores(spark, sf_dir), 5).where("score > 0.05"), "score")


@query(COSINE_SQL + " SELECT doc_id, round(score, 6) AS score FROM s WHERE score >= greatest(0.15e0, (SELECT avg(score) + 2.5e0 * coalesce(stddev_samp(score), 0) FROM s))")
def vector_zscore_gate(spark, sf_dir):
    return rounded(S.gate(cosine_scores(spark, sf_dir)), "score")


@query(
    bm25_sql("documents", {"body": ("text", 1.0)}, TERMS, "doc_id")
    + """, q AS (SELECT embedding AS vec FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.vec AS DOUBLE[])) AS score FROM embeddings, q),
    l AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM (SELECT * FROM scores ORDER BY round(score, 9) DESC, doc_id LIMIT 100)),
    m AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM (SELECT * FROM v ORDER BY round(score, 9) DESC, doc_id LIMIT 100))
    SELECT doc_id, round(coalesce(1e0 / (60 + l.r), 0) + coalesce(1e0 / (60 + m.r), 0), 9) AS score, CAST(l.r AS INTEGER) AS lex_rank, CAST(m.r AS INTEGER) AS sem_rank FROM l FULL JOIN m USING (doc_id)"""
)
def rrf_fusion(spark, sf_dir):
    near = lambda s: s.withColumn("score", F.round("score", 9))
    fused = S.fuse(near(S.bm25(document_index(spark, sf_dir), TERMS)), near(cosine_scores(spark, sf_dir)), window=100)
    return fused.withColumn("score", F.round("score", 9))


@query()
def hash_embedding_native(spark, sf_dir):
    return vectors.hash_embedding_rows(table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn")), "text", "id")


@query(
    """SELECT kind, min(value) AS value, count(*) AS n FROM (SELECT 'p_name' AS kind, p_name AS value FROM part UNION ALL SELECT 'p_type', CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE p_type END FROM part UNION ALL SELECT 'p_brand', p_brand FROM part) WHERE contains(lower(value), 'an') GROUP BY kind, lower(value) ORDER BY n DESC, length(min(value)), min(value), kind LIMIT 12"""
)
def suggest_typeahead(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("p_type", F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type")))
    return S.suggest(part.select("p_name", "p_type", "p_brand"), "an")


@query(
    r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), p AS (SELECT *, coalesce(nullif(strpos(lower(t), 'hat'), 0), nullif(strpos(lower(t), 'er'), 0)) AS pos FROM f),
    w AS (SELECT *, greatest(0, pos - 1 - 73) AS s, least(length(t), greatest(0, pos - 1 - 73) + 220) AS e FROM p)
    SELECT doc_id, CASE WHEN pos IS NULL THEN substr(t, 1, 220) || CASE WHEN length(t) > 220 THEN '...' ELSE '' END
      ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || substr(t, s + 1, e - s) || CASE WHEN e < length(t) THEN '...' ELSE '' END END AS snippet FROM w"""
)
def snippet_window(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet("text", "hat er").alias("snippet"))


# --- documents ------------------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' AND o_custkey NOT IN (1, 2, 3) AND o_totalprice > 1000 AND o_totalprice <= 400000
    AND contains(lower(o_orderpriority), 'e') AND o_custkey IS NOT NULL AND o_orderkey BETWEEN 10 AND 5000 AND regexp_matches(o_orderpriority, '(?i)^[0-9]-') AND NOT starts_with(lower(o_orderpriority), '9')"""
)
def filter_ops_all(spark, sf_dir):
    f = D.Filter
    filters = [f("o_orderstatus", "eq", "O"), f("o_orderpriority", "ne", "1-URGENT"), f("o_custkey", "nin", [1, 2, 3]), f("o_totalprice", "gt", 1000), f("o_totalprice", "lte", 400000), f("o_orderpriority", "contains", "E"), f("o_custkey", "exists", True), f("o_orderkey", "between", (10, 5000)), f("o_orderpriority", "regex", "^[0-9]-")]
    rows = D.matching(table(spark, sf_dir, "orders"), filters)
    return rows.where(~D.predicate(rows, f("o_orderpriority", "startswith", "9"))).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 ORDER BY o_orderpriority DESC NULLS FIRST, o_totalprice ASC NULLS LAST, o_orderkey LIMIT 50 OFFSET 20")
def find_sort_skip_limit(spark, sf_dir):
    q = D.Query((D.Filter("o_totalprice", "gte", 1000),), (("o_orderpriority", False), ("o_totalprice", True), ("o_orderkey", True)), 50, 20, ("o_orderkey", "o_custkey", "o_totalprice"))
    return D.find(table(spark, sf_dir, "orders"), q)


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand ORDER BY n DESC, value LIMIT 25")
def facet_counts(spark, sf_dir):
    return D.facet(table(spark, sf_dir, "part"), "p_brand", [D.Filter("p_size", "gt", 10)])


@query("SELECT value, count(*) AS n FROM (SELECT unnest(list_distinct(list(l_returnflag || l_linestatus))) AS value FROM lineitem GROUP BY l_orderkey) GROUP BY value ORDER BY n DESC, value LIMIT 25")
def facet_array(spark, sf_dir):
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("flags"))
    return D.facet(orders, "flags")


@query("SELECT 'n_regionkey' AS facet, CAST(n_regionkey AS VARCHAR) AS value, count(*) AS n FROM nation GROUP BY ALL UNION ALL SELECT 'n_name', n_name, count(*) FROM nation GROUP BY ALL")
def facets_one_pass(spark, sf_dir):
    return D.facets(table(spark, sf_dir, "nation"), ["n_regionkey", "n_name"])


@query("SELECT p_partkey, p_name, CAST(list_position([42, 7, 1999, 3, 999999999], p_partkey) - 1 AS INTEGER) AS place FROM part WHERE p_partkey IN (42, 7, 1999, 3, 999999999)")
def get_many_ordered(spark, sf_dir):
    ids = [42, 7, 1999, 3, 999999999]
    rows = D.get_many(table(spark, sf_dir, "part"), ids, "p_partkey")
    return rows.select("p_partkey", "p_name", (F.array_position(F.array(*[F.lit(i).cast("bigint") for i in ids]), F.col("p_partkey")) - 1).cast("int").alias("place"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
def count_filtered(spark, sf_dir):
    return D.count(table(spark, sf_dir, "lineitem"), [D.Filter("l_returnflag", "eq", "R")])


STATS = ["region", "nation", "customer", "supplier", "part", "orders", "documents", "pages", "conversations"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS collection, count(*) AS n FROM {t}" for t in STATS))
def collection_stats(spark, sf_dir):
    return D.stats({t: table(spark, sf_dir, t) for t in STATS})


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def passport_matrix(spark, sf_dir):
    return D.passport(table(spark, sf_dir, "documents"), "source", "lang", ["en", "fr", "de", "es"])


UPSERT_SQL = "SELECT user_id, event_id, event_type, strftime(created, '%Y-%m-%d %H:%M:%S') AS created FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n, min(ts) OVER (PARTITION BY user_id) AS created FROM events WHERE user_id IS NOT NULL) WHERE n = 1"


@query(UPSERT_SQL)
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("created_at", F.col("ts"))
    out = D.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")
    return out.select("user_id", "event_id", "event_type", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")
def json_path_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("props", F.from_json("props", "map<string,bigint>"))
    return D.matching(e, [D.Filter("props.k", "gt", 50)]).select("event_id", F.col("props.k").alias("k"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE ends_with(lower(n_name), '1')")
def filter_endswith_join(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return D.matching(j, [D.Filter("n_name", "endswith", "1")]).select("c_custkey", "n_name")


# --- text -----------------------------------------------------------------------------------------

HTML_SQL = r"""replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"""


@query(f"SELECT page_id, trim(regexp_replace({HTML_SQL}, '\\s+', ' ', 'g')) AS clean FROM pages")
def html_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.flatten_space(text.strip_html("html")).alias("clean"))


@query("SELECT doc_id, 'sha256:' || substr(sha256(text), 1, 32) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash("text").alias("hash"))


EMAIL_RX = r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]{2,}\b"


@query(f"SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '{EMAIL_RX}'), lambda x: lower(x)))) AS emails FROM documents WHERE regexp_matches(text, '{EMAIL_RX}')")
def entities_extract(spark, sf_dir):
    e = table(spark, sf_dir, "documents").select("doc_id", text.extract_entities("text").alias("e"))
    return e.select("doc_id", F.col("e.emails").alias("emails")).where(F.size("emails") > 0)


@query("SELECT c_custkey, 'user' || c_custkey || '@org' || c_nationkey || '.io' AS email FROM customer")
def signature_block(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    body = F.concat(F.lit("Hello\nthe figures are done.\nRegards\n"), F.col("c_name"), F.lit("\nUSER"), F.col("c_custkey"), F.lit("@org"), F.col("c_nationkey"), F.lit(".io"))
    return c.select("c_custkey", text.signature_block(body)["email"].alias("email"))


BODY_SQL = "'Order ' || o_orderkey || ' for @cust' || o_custkey || CASE o_orderkey % 4 WHEN 0 THEN ' must ship by ' WHEN 1 THEN ' should arrive before ' WHEN 2 THEN ' hopefully due ' ELSE ' was placed on ' END || strftime(CAST(o_orderdate AS DATE) + INTERVAL 7 DAY, '%Y-%m-%d') || '. '"
LAST_SQL = "CASE o_orderstatus WHEN 'O' THEN 'We decided to keep it.' WHEN 'F' THEN 'The change was rejected.' ELSE 'What is the status?' END"
MESSAGES_SQL = f"messages AS (SELECT 'order:' || o_orderkey AS _id, o_orderdate AS ts, o_orderpriority AS provider, 'cust:' || o_custkey AS sender_ref, CAST(o_custkey AS VARCHAR) AS conversation_id, {BODY_SQL} || {LAST_SQL} AS body_text, {LAST_SQL} AS last FROM orders)"


def order_messages(spark, sf_dir) -> DataFrame:
    """One message per order, with dates, deadlines, handles, decisions and questions."""
    k = F.col("o_orderkey")
    verb = F.when(k % 4 == 0, " must ship by ").when(k % 4 == 1, " should arrive before ").when(k % 4 == 2, " hopefully due ").otherwise(" was placed on ")
    last = F.when(F.col("o_orderstatus") == "O", "We decided to keep it.").when(F.col("o_orderstatus") == "F", "The change was rejected.").otherwise("What is the status?")
    day = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 7), "yyyy-MM-dd")
    body = F.concat(F.lit("Order "), k, F.lit(" for @cust"), "o_custkey", verb, day, F.lit(". "), last)
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), k).alias("_id"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("provider"), F.concat(F.lit("cust:"), "o_custkey").alias("sender_ref"), F.col("o_custkey").cast("string").alias("conversation_id"), body.alias("body_text"), last.alias("last"))


@query(f"WITH {MESSAGES_SQL} SELECT _id, list_sort(list_distinct(regexp_extract_all(body_text, '@([A-Za-z0-9._-]{{2,30}})\\b', 1))) AS handles FROM messages")
def entities_handles(spark, sf_dir):
    return order_messages(spark, sf_dir).select("_id", text.extract_entities("body_text")["handles"].alias("handles"))


@query(f"WITH {MESSAGES_SQL} SELECT _id, list_distinct(regexp_extract_all(body_text, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1)) AS dates FROM messages")
def dates_extract_iso(spark, sf_dir):
    return order_messages(spark, sf_dir).select("_id", dates.iso_dates("body_text").alias("dates"))


@query(
    """WITH m AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, month(o_orderdate + INTERVAL 40 DAY) AS mo, day(o_orderdate + INTERVAL 40 DAY) AS d, year(o_orderdate) AS y FROM orders),
    t AS (SELECT o_orderkey, a, CASE WHEN mo = 2 AND d = 29 THEN NULL ELSE make_date(y, mo, d) END AS d0, CASE WHEN mo = 2 AND d = 29 THEN NULL ELSE make_date(y + 1, mo, d) END AS d1 FROM m)
    SELECT o_orderkey, strftime(CASE WHEN d0 < a - INTERVAL 1 DAY THEN d1 ELSE d0 END, '%Y-%m-%d') AS due FROM t WHERE d0 IS NOT NULL"""
)
def dates_month_name(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    later = F.date_add(F.col("o_orderdate").cast("date"), 40)
    body = F.concat(F.lit("ready on "), F.date_format(later, "MMM d"))
    rows = o.where(F.date_format(later, "MM-dd") != "02-29").select("o_orderkey", dates.month_name_dates(body, F.col("o_orderdate")).alias("d"))
    return rows.select("o_orderkey", F.get("d", F.lit(0)).alias("due"))


@query(
    """SELECT o_orderkey, strftime(CASE o_orderkey % 6 WHEN 0 THEN d + INTERVAL 1 DAY WHEN 1 THEN d - INTERVAL 1 DAY WHEN 2 THEN d + INTERVAL 7 DAY WHEN 3 THEN d + INTERVAL 1 MONTH WHEN 4 THEN last_day(d) ELSE d + CAST((7 - isodow(d)) AS INTEGER) * INTERVAL 1 DAY END, '%Y-%m-%d') AS due
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""
)
def dates_relative(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    phrase = F.when(k == 0, "tomorrow").when(k == 1, "yesterday").when(k == 2, "next week").when(k == 3, "next month").when(k == 4, "end of month").otherwise("this week")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", dates.relative_dates(F.concat(F.lit("send it "), phrase), F.col("o_orderdate")).alias("d"))
    return rows.select("o_orderkey", F.get("d", F.lit(0)).alias("due"))


@query(
    """SELECT o_orderkey, due, kind FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) CROSS JOIN LATERAL (
    SELECT strftime(d + INTERVAL 3 DAY, '%Y-%m-%dT18:00:00Z') AS due, 'relative' AS kind UNION ALL SELECT strftime(d + INTERVAL 7 DAY, '%Y-%m-%dT00:00:00Z'), 'absolute')"""
)
def dates_full_grammar(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    body = F.concat(F.lit("in 3 days or on "), F.date_format(F.date_add(day, 7), "yyyy-MM-dd"))
    rows = o.select("o_orderkey", F.explode(dates.extract_dates(body, F.date_format(day, "yyyy-MM-dd'T'00:00:00'Z'"))).alias("d"))
    return rows.select("o_orderkey", F.col("d.value").alias("due"), F.col("d.kind").alias("kind"))


DEADLINES_SQL = f"""{MESSAGES_SQL}, deadlines AS (SELECT _id, ts, conversation_id, due, hardness, CASE hardness WHEN 'hard' THEN 0.85e0 WHEN 'soft' THEN 0.4e0 ELSE 0.6e0 END AS confidence FROM (
  SELECT 'order:' || o_orderkey AS _id, o_orderdate AS ts, CAST(o_custkey AS VARCHAR) AS conversation_id, strftime(CAST(o_orderdate AS DATE) + INTERVAL 7 DAY, '%Y-%m-%d') AS due, CASE o_orderkey % 4 WHEN 0 THEN 'hard' WHEN 1 THEN 'medium' ELSE 'soft' END AS hardness FROM orders WHERE o_orderkey % 4 <> 3))"""


def order_deadlines(spark, sf_dir) -> DataFrame:
    rows = order_messages(spark, sf_dir).withColumn("d", F.explode(dates.iso_deadlines("body_text")))
    return rows.select("_id", "ts", "conversation_id", F.col("d.due_date").alias("due"), "d.hardness", "d.confidence", "d.cue")


@query(f"WITH {DEADLINES_SQL} SELECT _id, due, hardness, confidence FROM deadlines")
def deadlines_extract(spark, sf_dir):
    return order_deadlines(spark, sf_dir).select("_id", "due", "hardness", "confidence")


NOW = "1998-01-01 00:00:00"


@query(
    f"""WITH {DEADLINES_SQL}, d AS (SELECT *, CAST(date_diff('day', DATE '1998-01-01', CAST(due AS DATE)) AS INTEGER) AS days FROM deadlines WHERE CAST(due AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-01-01' + INTERVAL 45 DAY)
    SELECT _id, days, round(CASE hardness WHEN 'hard' THEN 1e0 WHEN 'medium' THEN 0.7e0 ELSE 0.35e0 END / (1e0 + days / 10e0) * confidence, 6) AS score FROM d"""
)
def deadline_predictions(spark, sf_dir):
    rows = order_deadlines(spark, sf_dir).withColumn("due", F.to_timestamp("due"))
    return rounded(P.deadline_predictions(rows, F.to_timestamp(F.lit(NOW))).select("_id", "days", "score"), "score")


def clause_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '@[A-Za-z0-9_][A-Za-z0-9_.\-]*', '', 'g'), 'https?://\S+', '', 'g'), '\s+', ' ', 'g'), ' .,:;-')"


def bare_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '{text.RE_SUBJECT_PREFIX}', ''), '{text.RE_FILLER_TAIL}', ''), ' .,:;-')"


def words_sql(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda z: z <> ''))"


@query(
    rf"""WITH f AS (SELECT conv_id, arg_min(text, turn) AS body FROM conversations GROUP BY conv_id),
    p AS (SELECT conv_id, string_split(replace(regexp_replace(trim(regexp_replace(trim(coalesce(body, '')), '^>[^\n]*(?:\n|$)', '', 'g')), '([.!?])\s', '\1' || chr(1), 'g'), chr(10), chr(1)), chr(1)) AS parts FROM f),
    h AS (SELECT conv_id, parts, parts[1] AS head, {clause_sql("parts[1]")} AS c FROM p),
    g AS (SELECT conv_id, parts, CASE WHEN regexp_matches(head, '^@[A-Za-z0-9_]') THEN regexp_replace(c, '^[A-Z][A-Za-z0-9_''’-]+(?:\s+[A-Z][A-Za-z0-9_''’-]+)?\s+', '') ELSE c END AS c FROM h),
    i AS (SELECT conv_id, {bare_sql("regexp_replace(c, '^[A-Z][A-Za-z0-9_''’-]{0,24}:[ ]+', '')")} AS one, list_filter(list_transform(parts, lambda y: {bare_sql(clause_sql("y"))}), lambda y: {words_sql("y")} >= 4)[1] AS later FROM g),
    s AS (SELECT conv_id, CASE WHEN {words_sql("one")} < 4 THEN coalesce(later, one) ELSE one END AS s FROM i)
    SELECT CAST(conv_id AS VARCHAR) AS thread, CASE WHEN length(s) > 90 THEN regexp_replace(substr(s, 1, 90), ' [^ ]*$', '') || '...' ELSE s END AS subject FROM s"""
)
def thread_subjects(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.format_string("%d:%04d", "conv_id", "turn").alias("_id"), F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("ts"), F.col("text").alias("body_text"))
    return P.thread_subjects(c)


@query(
    f"""WITH {MESSAGES_SQL} SELECT _id, round(least(1e0, (CASE WHEN CAST(substr(_id, 7) AS BIGINT) % 4 <> 3 THEN 2e0 ELSE 0e0 END + CASE WHEN regexp_matches(body_text, '(?i)\\b(decid[A-Za-z0-9_]*|agreed|approv[A-Za-z0-9_]*|final[A-Za-z0-9_]*|ship[A-Za-z0-9_]*|confirm[A-Za-z0-9_]*|owner)\\b') THEN 1.8e0 ELSE 0e0 END
    + sqrt(greatest(0, len(list_filter(regexp_split_to_array(body_text, '\\s+'), lambda w: w <> '')) - 20) / 180e0) + 1.4e0 * pow(0.5e0, greatest(0e0, date_diff('day', ts, TIMESTAMP '1998-01-01 00:00:00')) / 21e0) + 0.6e0) / 12e0), 6) AS importance FROM messages"""
)
def importance_score(spark, sf_dir):
    m = order_messages(spark, sf_dir)
    scored = P.importance(m, F.to_timestamp(F.lit(NOW)), deadlines=F.size(dates.iso_deadlines("body_text")) > 0, inbound=F.lit(True))
    return rounded(scored.select("_id", "importance"), "importance")


@query(
    f"""WITH {MESSAGES_SQL}, n AS (SELECT *, lead(last, 1) OVER w AS a, lead(last, 2) OVER w AS b, lead(last, 3) OVER w AS c FROM messages WINDOW w AS (PARTITION BY conversation_id ORDER BY ts, _id))
    SELECT _id, CAST(date_diff('day', ts, TIMESTAMP '2002-01-01 00:00:00') AS INTEGER) AS days, round(0.5e0 + least(0.35e0, date_diff('day', ts, TIMESTAMP '2002-01-01 00:00:00') / 200e0), 6) AS score FROM n
    WHERE starts_with(last, 'What') AND b IS NOT NULL AND NOT regexp_matches(a || b || coalesce(c, ''), 'https?://')"""
)
def follow_up_questions(spark, sf_dir):
    m = order_messages(spark, sf_dir).drop("body_text").withColumnRenamed("last", "body_text")
    return rounded(P.follow_ups(m, F.to_timestamp(F.lit("2002-01-01 00:00:00"))).select("_id", "days", "score"), "score")


@query(
    """WITH r AS (SELECT CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id < 3), o AS (SELECT vec_id AS _id, CAST(100 + vec_id % 200 AS INTEGER) AS days, max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), r.a)) AS s FROM embeddings, r WHERE vec_id >= 3 GROUP BY ALL)
    SELECT _id, days, round(s, 6) AS similarity, round(s * (1 + least(0.5e0, days / 400e0)), 6) AS score FROM o WHERE s >= 0.30"""
)
def resurfacing(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    old = v.where("vec_id >= 3").select(F.col("vec_id").alias("_id"), (now - F.make_dt_interval((100 + F.col("vec_id") % 200).cast("int"))).alias("ts"), F.lit(100).alias("chars"), F.col("embedding").alias("vec"))
    out = P.resurfacing(old, v.where("vec_id < 3").select(F.col("embedding").alias("vec")), now)
    return rounded(out, "similarity", "score")


@query()
def textrank_summary(spark, sf_dir):
    return Z.summaries(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    r"""SELECT doc_id, list_slice(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), '\n{2,}', chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''), 1, 3) AS summary FROM documents"""
)
def lead_summary(spark, sf_dir):
    return Z.lead(table(spark, sf_dir, "documents"), "doc_id", "text", 3)


@query(
    f"""WITH s AS (SELECT conv_id * 1000 + turn AS id, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+([A-Z0-9"''(])', '\\1' || chr(1) || '\\2', 'g'), '\\n{{2,}}', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS s, generate_subscripts(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+([A-Z0-9"''(])', '\\1' || chr(1) || '\\2', 'g'), '\\n{{2,}}', chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 AS sentence FROM conversations),
    tf AS (SELECT id, sentence, term, count(*) AS tf FROM (SELECT id, sentence, unnest(list_transform(list_filter(list_transform(regexp_extract_all(lower(s), '[A-Za-z0-9_@''.+-]+'), lambda x: trim(x, '.''-')), lambda x: length(x) >= 2 AND x NOT IN ({quoted(STOPWORDS)}) AND NOT regexp_matches(x, '^[0-9]+$')), lambda w: {stem_sql("w")})) AS term FROM s) GROUP BY ALL),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id), df AS (SELECT id, term, count(*) AS df FROM tf GROUP BY ALL), w AS (SELECT id, sentence, term, (1 + ln(tf)) * (ln((n + 1e0) / (df + 1e0)) + 1) AS w FROM tf JOIN n USING (id) JOIN df USING (id, term))
    SELECT id, CAST(sentence AS INTEGER) AS sentence, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id, sentence)), 6) AS weight FROM w"""
)
def tfidf_sentence_vectors(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return rounded(Z.sentence_tfidf(c, "id", "text"), "weight")


# --- interactions and detectors -------------------------------------------------------------------

EVENTS_SQL = "ev AS (SELECT event_type || '|' || strftime(ts, '%Y-%m-%d') || '|' || hour(ts) AS g, user_id AS r, ts, event_id FROM events), pr AS (SELECT DISTINCT least(e.r, o.r) AS a, greatest(e.r, o.r) AS b, e.ts, e.event_id FROM ev e JOIN (SELECT DISTINCT g, r FROM ev) o ON e.g = o.g AND e.r <> o.r)"


def event_docs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    g = F.concat("event_type", F.lit("|"), F.date_format("ts", "yyyy-MM-dd"), F.lit("|"), F.hour("ts").cast("string"))
    return e.select(g.alias("conversation_id"), F.col("user_id").alias("sender_ref"), "ts", F.col("event_id").alias("_id"))


def event_pairs(spark, sf_dir) -> DataFrame:
    return N.interactions(event_docs(spark, sf_dir))


@query("SELECT event_type AS conversation_id, list(user_id ORDER BY n DESC, user_id) AS participants FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def participants_ranked(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("conversation_id"), F.col("user_id").alias("sender_ref"))
    return N.participants(e)


@query(f"WITH {EVENTS_SQL} SELECT a, b, count(*) AS n FROM pr GROUP BY ALL")
def interaction_pairs(spark, sf_dir):
    return N.meetings(event_docs(spark, sf_dir), last=False)


@query(f"WITH {EVENTS_SQL} SELECT count(*) AS pairs, sum(n)::BIGINT AS interactions, max(n) AS most FROM (SELECT a, b, count(*) AS n FROM pr GROUP BY ALL)")
def interaction_stats(spark, sf_dir):
    return N.interaction_stats(N.meetings(event_docs(spark, sf_dir), last=False))


EVENT_NOW = "2024-01-31 00:00:00"


@query(f"WITH {EVENTS_SQL} SELECT a, b, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, round(least(0.9e0, 0.45e0 + 0.05e0 * count(*)), 6) AS confidence FROM pr GROUP BY a, b HAVING count(*) >= 4 AND max(ts) <= TIMESTAMP '2024-01-21 00:00:00'")
def dormant_pairs(spark, sf_dir):
    out = N.dormant_meetings(N.meetings(event_docs(spark, sf_dir), least=4), F.to_timestamp(F.lit(EVENT_NOW)), days=10)
    return rounded(out.select("a", "b", "n", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "confidence"), "confidence")


@query(
    """WITH l AS (SELECT user_id, event_type, ts, lag(ts, 7) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS s FROM events)
    SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS "end", 8 AS n FROM l WHERE ts - s <= INTERVAL 14 DAY GROUP BY ALL"""
)
def burst_pairs(spark, sf_dir):
    out = N.bursts(table(spark, sf_dir, "events"), ["user_id", "event_type"], tie="event_id")
    return out.select("user_id", "event_type", F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


HIDDEN_SQL = f"""{EVENTS_SQL}, e AS (SELECT DISTINCT a, b FROM pr), k AS (SELECT a AS h, b AS x FROM e UNION SELECT b, a FROM e),
    m AS (SELECT p.x AS a, q.x AS b, count(*) AS mutual FROM k p JOIN k q ON p.h = q.h AND p.x < q.x GROUP BY ALL HAVING count(*) >= 2), hi AS (SELECT a, b, mutual, least(0.55e0, 0.2e0 + 0.1e0 * mutual) AS confidence FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.a = m.a AND e.b = m.b))"""


def hidden(spark, sf_dir, **options):
    return N.hidden_in_groups(event_docs(spark, sf_dir), evidence=False, **options)


@query(f"WITH {HIDDEN_SQL} SELECT a, b, mutual, round(confidence, 6) AS confidence FROM hi")
def hidden_introducer(spark, sf_dir):
    return rounded(hidden(spark, sf_dir), "confidence")


@query("SELECT 'c' || o_custkey || ':' || year(o_orderdate) AS person_id, min(o_orderpriority) AS provider, count(*) AS message_count, 0.4e0 AS confidence FROM orders GROUP BY o_custkey, year(o_orderdate) HAVING count(DISTINCT o_orderpriority) = 1 AND count(*) >= 2")
def single_source(spark, sf_dir):
    person = F.concat(F.lit("c"), "o_custkey", F.lit(":"), F.year("o_orderdate"))
    p = table(spark, sf_dir, "orders").groupBy(person.alias("person_id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("providers"), F.count(F.lit(1)).alias("message_count"))
    return N.single_source(p, least=2)


SIGNATURE_SQL = f"array_to_string(list_slice(list_sort(list_distinct(list_filter(regexp_extract_all(lower(s), '[a-z0-9'']+'), lambda w: length(w) > 2 AND w NOT IN ({quoted([*SIGNATURE_STOPWORDS, *SIGNATURE_EXTRA])})))), 1, 6), ' ')"


@query(
    f"""WITH t AS (SELECT o_orderpriority AS provider, CASE o_orderstatus WHEN 'O' THEN 'We will do ' ELSE 'Not approved: ' END || lower(c_mktsegment) || ' pricing nation' || c_nationkey || ' approved' AS s, o_orderstatus = 'O' AS accept FROM orders JOIN customer ON o_custkey = c_custkey),
    g AS (SELECT {SIGNATURE_SQL} AS signature, provider, accept FROM t)
    SELECT signature, count(DISTINCT provider) AS providers, count(*) AS accepts, count(*) FILTER (NOT accept) AS rejects, 0.7e0 AS confidence FROM g GROUP BY signature HAVING count(DISTINCT provider) >= 2 AND count(*) FILTER (NOT accept) > 0"""
)
def decision_divergence(spark, sf_dir):
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    cue = F.when(F.col("o_orderstatus") == "O", "We will do ").otherwise("Not approved: ")
    body = F.concat(cue, F.lower("c_mktsegment"), F.lit(" pricing nation"), F.col("c_nationkey"), F.lit(" approved"))
    return N.decision_divergence(j.select(F.col("o_orderkey").alias("_id"), F.col("o_orderpriority").alias("provider"), body.alias("body_text")))


@query(
    """WITH r AS (SELECT l_partkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1), s AS (SELECT count(*) AS n FROM supplier)
    SELECT 'part:' || p_partkey AS _id, r.n AS "references" FROM part JOIN r ON l_partkey = p_partkey CROSS JOIN s LEFT JOIN supplier ON s_suppkey = p_partkey % s.n AND s_acctbal > 0 WHERE s_suppkey IS NULL"""
)
def orphan_files(spark, sf_dir):
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    n = F.broadcast(supplier.agg(F.count(F.lit(1)).alias("n")))
    files = part.crossJoin(n).select(F.concat(F.lit("part:"), "p_partkey").alias("_id"), F.col("p_partkey").alias("provider_file_id"), (F.col("p_partkey") % F.col("n")).cast("string").alias("owner_ref"))
    attached = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("provider_file_id")).distinct()
    known = supplier.where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("ref"))
    return N.orphan_files(files, N.file_references(attached, "provider_file_id"), known, providers=None).select("_id", "references")


# --- identities -----------------------------------------------------------------------------------

IDENTITIES_SQL = """raw AS (SELECT 'crm' AS provider, c_custkey AS k, c_nationkey AS nk, NULL::TIMESTAMP AS seen FROM customer UNION ALL SELECT 'shop', c_custkey, c_nationkey, min(o_orderdate) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL UNION ALL SELECT 'vendor', s_suppkey, s_nationkey, NULL FROM supplier),
    ids AS (SELECT provider || ':' || k AS _id, provider, CAST(k AS VARCHAR) AS handle, 'name' || k % 97 || ' family' || k % 31 AS display_name, 'user' || k % 700 || '@org' || nk || '.io' AS email, substr(sha256('user' || k % 700 || '@org' || nk || '.io'), 1, 32) AS email_token, 'name' || k % 97 || ' family' || k % 31 AS name_token, k % 50 AS mention_count, seen FROM raw)"""
KEYS_SQL = """keys AS (SELECT DISTINCT key, _id AS id FROM (SELECT 'em:' || email_token AS key, _id FROM ids UNION ALL SELECT 'nm:' || name_token, _id FROM ids UNION ALL SELECT 'np:' || substr(name_token, 1, 8) || ':' || length(name_token) // 8, _id FROM ids WHERE length(name_token) >= 8 UNION ALL SELECT 'hd:' || provider || ':' || handle, _id FROM ids)), sizes AS (SELECT key, count(*) AS size FROM keys GROUP BY key),
    pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM keys x JOIN keys y ON x.key = y.key AND x.id < y.id JOIN sizes s ON s.key = x.key WHERE size BETWEEN 2 AND 400)"""
SCORES_SQL = """scores AS (SELECT a, b, greatest(0e0, least(1e0, least(1e0, CASE WHEN x.email_token = y.email_token THEN 1e0 ELSE 0e0 END + CASE WHEN split_part(x.display_name, ' ', 1) = split_part(y.display_name, ' ', 1) THEN 0.6e0 WHEN contains(y.display_name, split_part(x.display_name, ' ', 1)) OR contains(x.display_name, split_part(y.display_name, ' ', 1)) THEN 0.35e0 ELSE 0e0 END
      + CASE WHEN split_part(x.email, '@', 2) = split_part(y.email, '@', 2) THEN 0.15e0 ELSE 0e0 END) - CASE WHEN x.email_token = y.email_token THEN 0e0 ELSE CASE WHEN split_part(x.email, '@', 2) <> split_part(y.email, '@', 2) THEN 0.2e0 ELSE 0e0 END
      + CASE WHEN x.provider <> y.provider AND x.handle <> y.handle AND split_part(x.display_name, ' ', 1) = split_part(y.display_name, ' ', 1) THEN 0.5e0 ELSE 0e0 END + CASE WHEN abs(date_diff('day', x.seen, y.seen)) > 400 THEN 0.4e0 ELSE 0e0 END END)) AS score FROM pairs JOIN ids x ON x._id = a JOIN ids y ON y._id = b)"""
PEOPLE_SQL = f"WITH RECURSIVE {IDENTITIES_SQL}, {KEYS_SQL}, {SCORES_SQL}, m AS (SELECT a, b FROM scores WHERE score >= 0.9 UNION SELECT b, a FROM scores WHERE score >= 0.9), reach(n, l) AS (SELECT _id, _id FROM ids UNION SELECT m.b, reach.l FROM reach JOIN m ON m.a = reach.n), cl AS (SELECT n AS _id, min(l) AS cluster FROM reach GROUP BY n)"


def identities(spark, sf_dir) -> DataFrame:
    """crm, shop and vendor identities with colliding names and addresses."""
    c, o, s = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    none = F.lit(None).cast("timestamp")
    crm = c.select(F.lit("crm").alias("provider"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nk"), none.alias("seen"))
    seen = o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("seen"))
    shop = c.join(seen, F.col("c_custkey") == F.col("o_custkey")).select(F.lit("shop"), "c_custkey", "c_nationkey", "seen")
    raw = crm.union(shop).union(s.select(F.lit("vendor"), "s_suppkey", "s_nationkey", none))
    ref = F.concat_ws(":", "provider", F.col("k").cast("string"))
    name = F.concat(F.lit("name"), F.col("k") % 97, F.lit(" family"), F.col("k") % 31)
    mail = F.concat(F.lit("user"), F.col("k") % 700, F.lit("@org"), F.col("nk"), F.lit(".io"))
    return raw.select(
        ref.alias("_id"), ref.alias("ref"), "provider", F.col("k").cast("string").alias("provider_user_id"), name.alias("display_name"), mail.alias("email"), F.lit("").alias("phone"), F.substring(F.sha2(mail, 256), 1, 32).alias("email_token"), F.lit(None).cast("string").alias("phone_token"),
        name.alias("name_token"), (F.col("k") % 50).alias("mention_count"), F.date_format("seen", "yyyy-MM-dd").alias("first_seen"), F.lit("").alias("last_seen"), F.lit(False).alias("is_self"),
    )


def scored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ids = identities(spark, sf_dir)
    return ids, I.score_pairs(I.candidate_pairs(I.block_keys(ids)), ids)


@query(f"WITH {IDENTITIES_SQL}, {KEYS_SQL} SELECT key, id FROM keys")
def block_keys(spark, sf_dir):
    return I.block_keys(identities(spark, sf_dir))


@query(f"WITH {IDENTITIES_SQL}, {KEYS_SQL} SELECT a, b FROM pairs")
def candidate_pairs(spark, sf_dir):
    return I.candidate_pairs(I.block_keys(identities(spark, sf_dir)))


@query(f"WITH {IDENTITIES_SQL}, {KEYS_SQL} SELECT key, size FROM sizes WHERE size > 400")
def oversize_blocks(spark, sf_dir):
    return I.oversize_blocks(I.block_keys(identities(spark, sf_dir)))


@query(
    f"""WITH {IDENTITIES_SQL}, {KEYS_SQL} SELECT n AS identities, b AS blocks, o AS oversize, c AS candidate_pairs, n * (n - 1) // 2 AS all_pairs, round(1 - c / (n * (n - 1) / 2), 4) AS reduction_ratio
    FROM (SELECT (SELECT count(*) FROM ids) AS n, (SELECT count(*) FROM sizes WHERE size BETWEEN 2 AND 400) AS b, (SELECT count(*) FROM sizes WHERE size > 400) AS o, (SELECT count(*) FROM pairs) AS c)"""
)
def blocking_stats(spark, sf_dir):
    ids = identities(spark, sf_dir)
    return I.blocking_stats(ids, I.block_keys(ids))


@query("SELECT DISTINCT least(x.user_id, y.user_id) AS a, greatest(x.user_id, y.user_id) AS b FROM events x JOIN events y ON x.event_type = y.event_type AND x.user_id <> y.user_id AND y.ts - x.ts BETWEEN INTERVAL 0 SECOND AND INTERVAL 600 SECOND")
def cooccurrence_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("conversation_id"), F.col("user_id").alias("sender_ref"), "ts")
    return I.cooccurrence_pairs(e, seconds=600)


@query(f"WITH {IDENTITIES_SQL}, {KEYS_SQL}, {SCORES_SQL} SELECT a, b, round(score, 6) AS score, CASE WHEN score >= 0.9 THEN 'merge' WHEN score >= 0.65 THEN 'suggest' ELSE 'distinct' END AS decision FROM scores")
def pair_scores(spark, sf_dir):
    return rounded(scored(spark, sf_dir)[1].select("a", "b", "score", "decision"), "score")


@query(f"WITH {IDENTITIES_SQL}, {KEYS_SQL}, {SCORES_SQL} SELECT a, b, round(score, 6) AS score FROM scores WHERE score >= 0.65 AND score < 0.9")
def link_suggestions(spark, sf_dir):
    return rounded(I.suggestions(scored(spark, sf_dir)[1]).select("a", "b", "score"), "score")


@query(PEOPLE_SQL + " SELECT _id, cluster FROM cl")
def person_clusters(spark, sf_dir):
    ids, scores = scored(spark, sf_dir)
    return I.clusters(ids, scores)


@query(
    PEOPLE_SQL
    + """ SELECT cluster, list_sort(list(DISTINCT provider)) AS providers, count(DISTINCT provider) > 1 AS cross_source, count(*) AS identities, CAST(sum(mention_count) AS BIGINT) AS message_count, arg_min(_id, (-mention_count, coalesce(strftime(seen, '%Y-%m-%d'), '~'), provider, _id)) AS primary_ref FROM cl JOIN ids USING (_id) GROUP BY cluster"""
)
def persons(spark, sf_dir):
    ids, scores = scored(spark, sf_dir)
    return I.persons(ids, I.clusters(ids, scores)).select("cluster", "providers", "cross_source", F.size("identity_ids").cast("bigint").alias("identities"), "message_count", "primary_ref")


PEPPER = b"0123456789abcdef0123456789abcdef"
_INNER, _OUTER = (bytes(b ^ x for b in PEPPER.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@query(f"WITH {IDENTITIES_SQL} SELECT _id, 'dd_' || substr(sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode('email|' || lower(trim(email)))))), 1, 32) AS token FROM ids")
def identity_tokens(spark, sf_dir):
    return identities(spark, sf_dir).select("_id", privacy.identity_token(PEPPER, "email", privacy.normalize_email("email")).alias("token"))


@query("SELECT doc_id, text FROM documents")
def seal_roundtrip(spark, sf_dir):
    key, doc = privacy.KeyRing(b"master key of a test", "ws").data_key("documents"), F.col("doc_id").cast("string")
    sealed = table(spark, sf_dir, "documents").select("doc_id", privacy.seal("text", key, "ws", doc, "text").alias("s"))
    return sealed.select("doc_id", privacy.unseal(F.col("s"), key, "ws", doc, "text").alias("text"))


# --- graph ----------------------------------------------------------------------------------------

NODES_SQL = "nodes AS (SELECT 'r' || r_regionkey AS id, 'Region' AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'Nation' FROM nation UNION ALL SELECT 'c' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 's' || s_suppkey, 'Supplier' FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'Order' FROM orders)"
EDGES_SQL = "edges AS (SELECT 'n' || n_nationkey AS src, 'IN_REGION' AS type, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'IN_NATION', 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'IN_NATION', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || o_custkey, 'PLACED', 'o' || o_orderkey FROM orders)"
BOTH_SQL = "sym AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


def star_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    region, nation, supplier = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    k = lambda p, c: F.concat(F.lit(p), F.col(c))
    nodes = G.union([G.node(region, k("r", "r_regionkey"), "Region"), G.node(nation, k("n", "n_nationkey"), "Nation"), G.node(customer, k("c", "c_custkey"), "Customer", balance=F.col("c_acctbal")), G.node(supplier, k("s", "s_suppkey"), "Supplier"), G.node(orders, k("o", "o_orderkey"), "Order")])
    edges = G.union([G.edge(nation, k("n", "n_nationkey"), "IN_REGION", k("r", "n_regionkey")), G.edge(customer, k("c", "c_custkey"), "IN_NATION", k("n", "c_nationkey")), G.edge(supplier, k("s", "s_suppkey"), "IN_NATION", k("n", "s_nationkey")), G.edge(orders, k("c", "o_custkey"), "PLACED", k("o", "o_orderkey"))])
    return nodes, edges


@query(f"WITH {NODES_SQL} SELECT id, label FROM nodes")
def graph_nodes(spark, sf_dir):
    return star_graph(spark, sf_dir)[0].select("id", "label")


@query(f"WITH {EDGES_SQL} SELECT src, type, dst FROM edges")
def graph_edges(spark, sf_dir):
    return star_graph(spark, sf_dir)[1]


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY ALL")
def graph_census(spark, sf_dir):
    return G.census(*star_graph(spark, sf_dir))


DEPTH_SQL = "walk(id, d) AS (SELECT 'c7', 0 UNION SELECT sym.dst, d + 1 FROM walk JOIN sym ON sym.src = walk.id WHERE d < {n}), depth AS (SELECT id, min(d) AS depth FROM walk GROUP BY id)"


@query(f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, {BOTH_SQL}, {DEPTH_SQL.format(n=2)} SELECT id, label, depth FROM depth JOIN nodes USING (id) ORDER BY depth, id LIMIT 400")
def graph_ego2(spark, sf_dir):
    return G.ego(*star_graph(spark, sf_dir), "c7", 2)[0].select("id", "label", "depth")


@query(f"WITH RECURSIVE {NODES_SQL}, {EDGES_SQL}, {BOTH_SQL}, {DEPTH_SQL.format(n=2)}, v AS (SELECT id FROM depth JOIN nodes USING (id) ORDER BY depth, id LIMIT 400) SELECT src, type, dst FROM edges WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v) AND type = 'IN_NATION'")
def graph_ego_edges(spark, sf_dir):
    return G.ego(*star_graph(spark, sf_dir), "c7", 2, types=["IN_NATION"])[1]


@query(f"WITH RECURSIVE {EDGES_SQL}, {BOTH_SQL}, p(path, d) AS (SELECT ['c9'], 0 UNION ALL SELECT list_append(path, sym.dst), d + 1 FROM p JOIN sym ON sym.src = path[-1] WHERE d < 4 AND NOT list_contains(path, sym.dst) AND path[-1] <> 's6'), f AS (SELECT path, d FROM p WHERE path[-1] = 's6') SELECT path, CAST(d AS INTEGER) AS hops FROM f WHERE d = (SELECT min(d) FROM f)")
def graph_path(spark, sf_dir):
    return G.shortest_paths(star_graph(spark, sf_dir)[1], "c9", "s6", 4)


LINKS_SQL = "edges AS (SELECT DISTINCT 'p' || l_partkey AS src, 'o' || l_orderkey AS dst FROM lineitem)"


@query(f"WITH RECURSIVE {LINKS_SQL}, {BOTH_SQL}, p(path, d) AS (SELECT ['p1'], 0 UNION ALL SELECT list_append(path, sym.dst), d + 1 FROM p JOIN sym ON sym.src = path[-1] WHERE d < 4 AND NOT list_contains(path, sym.dst) AND path[-1] <> 'p2'), f AS (SELECT path, d FROM p WHERE path[-1] = 'p2') SELECT path, CAST(d AS INTEGER) AS hops FROM f WHERE d = (SELECT min(d) FROM f) ORDER BY path LIMIT 5")
def graph_many_paths(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    edges = G.edge(line, F.concat(F.lit("p"), "l_partkey"), "IN_ORDER", F.concat(F.lit("o"), "l_orderkey")).distinct()
    return G.shortest_paths(edges, "p1", "p2", 4)


@query(
    """WITH per AS (SELECT 'per_' || c_custkey AS pid, 'id:' || c_custkey AS iid, 'cust:' || c_custkey AS ref FROM customer WHERE c_acctbal > 0),
    m AS (SELECT 'order:' || o_orderkey AS id, 'cust:' || o_custkey AS ref, o_custkey AS k, 'shop:' || o_custkey AS conv, o_orderkey FROM orders)
    SELECT pid AS src, 'HAS_IDENTITY' AS type, iid AS dst FROM per UNION SELECT id, 'IN_CONVERSATION', conv FROM m UNION SELECT id, 'SENT_BY', coalesce(pid, 'per_unknown_cust_' || k) FROM m LEFT JOIN per USING (ref)
    UNION SELECT pid, 'PARTICIPATED_IN', conv FROM m JOIN per USING (ref) UNION SELECT id, 'ATTACHED_TO', 'shop:' || p_partkey FROM m JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
    UNION SELECT 'shop:' || p_partkey, 'OWNS', pid FROM part JOIN per ON ref = 'cust:' || p_size"""
)
def graph_project_edges(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("k"), "c_name")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    people = c.select(name("per_", "k").alias("person_id"), F.col("c_name").alias("display_name"), F.lit(0).alias("message_count"), F.array(name("id:", "k")).alias("identity_ids"))
    ids = c.select(name("id:", "k").alias("_id"), F.lit("shop").alias("provider"), name("cust:", "k").alias("ref"))
    held = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.struct(F.col("l_partkey").cast("string").alias("provider_file_id"))).alias("attachments"))
    none = F.lit("").alias
    msgs = table(spark, sf_dir, "orders").join(held, "o_orderkey", "left").select(name("order:", "o_orderkey").alias("_id"), F.lit("shop").alias("provider"), F.col("o_orderdate").cast("string").alias("ts"), name("cust:", "o_custkey").alias("sender_ref"), F.col("o_custkey").cast("string").alias("conversation_id"), none("reply_to_id"), none("thread_root_id"), "attachments")
    files = table(spark, sf_dir, "part").select(name("shop:", "p_partkey").alias("_id"), F.col("p_name").alias("name"), name("cust:", "p_size").alias("owner_ref"))
    return G.project({"persons": people, "identities": ids, "messages": msgs, "files": files})[1].select("src", "type", "dst")


@query(f"WITH {NODES_SQL}, {EDGES_SQL} SELECT DISTINCT id, label FROM nodes JOIN (SELECT dst AS id FROM edges WHERE src = 'n3' UNION SELECT src FROM edges WHERE dst = 'n3') USING (id) ORDER BY id LIMIT 200")
def graph_neighbors(spark, sf_dir):
    return G.neighbors(*star_graph(spark, sf_dir), "n3").select("id", "label")


@query("SELECT 'c' || c_custkey AS id, c_acctbal AS score FROM customer ORDER BY score DESC, id LIMIT 20")
def top_nodes(spark, sf_dir):
    return G.top_nodes(star_graph(spark, sf_dir)[0], "Customer", "balance", 20)


@query(f"WITH {HIDDEN_SQL} SELECT CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst, 'advisory' AS state FROM hi WHERE a % 2 = 0 AND b % 2 = 0")
def advisory_edges(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).where("id % 2 = 0").distinct()
    pairs = hidden(spark, sf_dir, ends=users, counts=False)
    found = N.as_insight(pairs, "hidden_introducer", F.format_string("%s %s", "a", "b"), F.array("a", "b"))
    return G.advisory_edges(found, None).select("src", "dst", "state")


# --- timelines, files, plans ----------------------------------------------------------------------


@query(
    """SELECT _id, ts FROM (SELECT * FROM (SELECT 'e' || event_id AS _id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events) UNION ALL SELECT 'o' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') FROM orders UNION ALL SELECT 'l' || l_orderkey || ':' || l_linenumber, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') FROM lineitem) ORDER BY ts DESC, _id LIMIT 50"""
)
def timeline_merge(spark, sf_dir):
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias("ts")
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("_id"), at("ts"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("_id"), at("o_orderdate"))
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("l"), "l_orderkey", F.lit(":"), "l_linenumber").alias("_id"), at("l_shipdate"))
    return D.timeline([e, o, li])


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def timeline_daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query('SELECT p_partkey, p_name, count(l_orderkey) AS "references" FROM part LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_partkey = p_partkey GROUP BY ALL')
def files_inventory(spark, sf_dir):
    attached = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).distinct()
    refs = N.file_references(attached, "p_partkey")
    return table(spark, sf_dir, "part").join(refs, "p_partkey", "left").select("p_partkey", "p_name", F.coalesce("references", F.lit(0)).alias("references"))


@query(
    "WITH c AS (SELECT conv_id, conv_id * 1000 + turn AS id, turn FROM conversations), j AS (SELECT a.id, b.id AS sibling, CAST(row_number() OVER (PARTITION BY a.id ORDER BY b.turn DESC, b.id) AS INTEGER) AS rank FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.id <> b.id) SELECT id, sibling, rank FROM j WHERE rank <= 10"
)
def siblings(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn")
    return D.siblings(c, "conv_id", "turn", "id").select("id", "sibling", "rank")


@query("SELECT source AS provider, 'message' AS kind, count(*) AS n FROM documents WHERE source = 'src3' GROUP BY ALL")
def nl_plan_execute(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), F.col("source").alias("provider"), F.lit("message").alias("kind"), F.lit("").alias("ts"))
    return execute(compile_question("how many messages are there? provider:src3"), docs)


# --- streams --------------------------------------------------------------------------------------


def event_stream(spark, sf_dir) -> DataFrame:
    folder = sf_dir.rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/events.parquet")
    single = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    reader = spark.readStream.schema(schema)  # a stream reads a folder, of which a single file is picked by name
    raw = reader.option("pathGlobFilter", "events.parquet").parquet(folder) if single else reader.parquet(f"{folder}/events.parquet")
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def stream_upsert(spark, sf_dir):
    folder = shared_dir(spark)
    latest = K.VersionedTable(spark, folder, "latest")
    K.follow(event_stream(spark, sf_dir), lambda rows: latest.merge(rows.withColumn("_ingested", F.col("event_id")), "user_id"), f"{folder}/checkpoint")
    return latest.read().select("user_id", "event_id", "event_type")


@query(
    """SELECT user_id, strftime(start, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT user_id, date_trunc('day', ts) - k * INTERVAL 1 DAY AS start FROM events, range(14) AS r(k)) GROUP BY user_id, start HAVING count(*) >= 8"""
)
def stream_burst_window(spark, sf_dir):
    folder = shared_dir(spark)
    found = K.VersionedTable(spark, folder, "windows")
    K.follow(K.burst_windows(event_stream(spark, sf_dir), ["user_id"]), found.replace, f"{folder}/checkpoint", "complete")
    return found.read().select("user_id", F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@query("SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR, true) AS INTEGER) AS new FROM events)) GROUP BY ALL) GROUP BY user_id")
def quiet_sessions(spark, sf_dir):
    sessions = K.quiet_sessions(table(spark, sf_dir, "events"), ["user_id"], gap="6 hours")
    return sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"))
