"""Full-text search: field-weighted BM25 over a long table of postings, a vector leg, rank fusion."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stem, tokenize
from ..functions.vectors import cosine

K1, B = 1.5, 0.75
# Weight of each field.
FIELDS = {"title": 3.0, "subject": 3.0, "sender_name": 1.6, "display_name": 2.0, "labels": 1.2, "name": 2.0, "channel": 1.4, "body": 1.0, "file_name": 1.8, "snippet": 0.6, "provider": 0.8}
PHRASE_BOOST = 2.5
SIMILARITY_FLOOR, SIGMAS = 0.15, 2.5


@dataclass(frozen=True)
class Index:
    """postings(term, doc_id, field, tf), one row each; documents(doc_id, lengths map); df(term, n)."""

    postings: DataFrame
    lengths: DataFrame  # doc_id, field, len
    documents: DataFrame  # doc_id and the shown columns
    fields: tuple[str, ...]

    def averages(self) -> DataFrame:
        """field, avg: mean length over all documents, absent fields as 0, at least 1 where that is 0."""
        n = self.documents.agg(F.count(F.lit(1)).alias("docs"))
        sums = self.lengths.groupBy("field").agg(F.sum("len").alias("total"))
        avg = F.col("total") / F.col("docs")
        return sums.crossJoin(F.broadcast(n)).select("field", "docs", F.when(avg > 0, avg).otherwise(1.0).alias("avg"))

    def document_frequency(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))

    def stats(self) -> DataFrame:
        """docs, terms, postings, terms_per_doc."""
        pairs = self.postings.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("c"))
        found = pairs.agg(F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"))
        docs = self.documents.agg(F.count(F.lit(1)).alias("docs"))
        return docs.crossJoin(found).select("docs", "terms", "postings", F.round(F.col("postings") / F.greatest("docs", F.lit(1)), 2).alias("terms_per_doc"))

    def terms_for(self, doc_id) -> DataFrame:
        return self.postings.where(F.col("doc_id") == F.lit(doc_id)).select("term").distinct()


def build_index(docs: DataFrame, id_col: str, fields: dict[str, Column]) -> Index:
    """Unpivot the fields, tokenize each once, count terms per document and field."""
    named = [F.struct(F.lit(name).alias("field"), tokenize(c).alias("tokens")) for name, c in fields.items()]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(*named)).alias("f")).select("doc_id", "f.*")
    postings = rows.select("doc_id", "field", F.explode("tokens").alias("term")).groupBy("term", "doc_id", "field").agg(F.count(F.lit(1)).alias("tf"))
    lengths = rows.select("doc_id", "field", F.size("tokens").alias("len")).where("len > 0")
    shown = docs.select(F.col(id_col).alias("doc_id"), *[F.coalesce(c, F.lit("")).alias(n) for n, c in fields.items()])
    return Index(postings, lengths, shown, tuple(fields))


def idf(docs: Column, df: Column) -> Column:
    return F.greatest(F.lit(0.05), F.log(1 + (docs - df + 0.5) / (df + 0.5)))


def bm25(index: Index, terms: list[str], allowed: DataFrame | None = None, phrases: list[str] = (), exclude: list[str] = (), weights: dict[str, float] = FIELDS) -> DataFrame:
    """doc_id, score > 0: terms are stemmed tokens, and one given twice scores twice.

    Only the postings of the query's terms are read. ``allowed`` (doc_id) restricts the candidates.
    Documents whose title or sender hold an excluded term go; a quoted phrase in them scores more.
    """
    spark = index.postings.sparkSession
    count = {t: float(terms.count(t)) for t in terms}
    asked = F.broadcast(spark.createDataFrame(list(count.items()) or [("", 0.0)], "term string, times double"))
    hits = index.postings.where(F.col("term").isin(list(count)))
    df = hits.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    if allowed is not None:
        hits = hits.join(allowed, "doc_id", "left_semi")
    weight = reduce(lambda c, kv: c.when(F.col("field") == kv[0], kv[1]), weights.items(), F.when(F.lit(False), 0.0)).otherwise(1.0)
    scored = hits.join(asked, "term").join(F.broadcast(df), "term").join(index.lengths, ["doc_id", "field"]).join(F.broadcast(index.averages()), "field")
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    out = scored.groupBy("doc_id").agg(F.sum(F.col("times") * idf(F.col("docs"), F.col("df")) * part).alias("score"))
    shown = [c for c in ("title", "sender_name") if c in index.fields]
    if (phrases or exclude) and shown:
        text = F.lower(F.concat_ws(" ", *[F.col(c) for c in shown]))
        out = out.join(index.documents, "doc_id")
        for t in exclude:
            out = out.where(~text.contains(t))
        if phrases:
            hit = reduce(lambda a, b: a | b, (text.contains(p.lower()) for p in phrases))
            out = out.withColumn("score", F.when(hit, F.col("score") * PHRASE_BOOST).otherwise(F.col("score")))
    return out.where("score > 0").select("doc_id", "score")


def without(scores: DataFrame, documents: DataFrame, exclude: list[str], shown: tuple[str, ...] = ("title", "sender_name")) -> DataFrame:
    """The scores of documents whose shown columns hold none of the excluded words; for every leg of a search."""
    if not exclude:
        return scores
    text = F.lower(F.concat_ws(" ", *[F.col(c) for c in shown]))
    hit = reduce(lambda a, b: a | b, (text.contains(t) for t in exclude))
    return scores.join(documents.where(hit).select("doc_id"), "doc_id", "left_anti")


def top(scores: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    out = scores.orderBy(F.desc("score"), "doc_id")
    return (out.offset(offset) if offset else out).limit(limit)


def window(limit: int) -> int:
    """How many results a page, its total and its facets look at."""
    return max(500, 20 * limit)


def page(scores: DataFrame, limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, total and whether it is exact): both over a window of results."""
    seen = top(scores, window(limit))
    total = seen.agg(F.count(F.lit(1)).alias("total")).withColumn("total_is_exact", F.col("total") < window(limit))
    return top(seen, limit, offset), total


def k_anonymous(index: Index, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """(postings of terms that k documents or more hold, counts of kept and dropped terms)."""
    df = index.document_frequency()
    kept = index.postings.join(df.where(F.col("df") >= k).select("term"), "term", "left_semi")
    return kept, df.agg(F.count_if(F.col("df") >= k).alias("kept"), F.count_if(F.col("df") < k).alias("dropped"))


def similar(vectors: DataFrame, query: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """doc_id, score: cosine of one query vector (a table of one row, vec) with all vectors."""
    return vectors.crossJoin(F.broadcast(query.limit(1))).select(F.col(id_col).alias("doc_id"), cosine(F.col(vec_col), F.col("vec")).alias("score"))


def gate(scores: DataFrame, floor: float = SIMILARITY_FLOOR, sigmas: float = SIGMAS) -> DataFrame:
    """Scores that stand out: at least the floor, and mean + sigmas sample deviations."""
    line = scores.agg((F.avg("score") + sigmas * F.coalesce(F.stddev_samp("score"), F.lit(0.0))).alias("line"))
    return scores.crossJoin(F.broadcast(line)).where(F.col("score") >= F.greatest(F.lit(floor), F.col("line"))).select("doc_id", "score")


def ranked(scores: DataFrame, window: int) -> DataFrame:
    """doc_id, rank of the best window scores; the limit comes first, so that the rank's sort is small."""
    best = top(scores, window)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))).select("doc_id", "rank")


def fuse(lexical: DataFrame, semantic: DataFrame, k: int = 60, window: int = 500) -> DataFrame:
    """Reciprocal rank fusion: doc_id, score, lex_rank, sem_rank."""
    lex, sem = ranked(lexical, window).withColumnRenamed("rank", "lex_rank"), ranked(semantic, window).withColumnRenamed("rank", "sem_rank")
    share = lambda r: F.coalesce(1.0 / (k + F.col(r)), F.lit(0.0))
    return lex.join(sem, "doc_id", "full_outer").select("doc_id", (share("lex_rank") + share("sem_rank")).alias("score"), "lex_rank", "sem_rank")


def suggest(columns: DataFrame, needle: str, limit: int = 12) -> DataFrame:
    """kind (the column), value, n of the string columns' values that contain needle, whatever their case: most frequent first, then shorter, then by value."""
    values = columns.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in columns.columns])).alias("v")).select("v.*")
    hit = values.where(F.lower("value").contains(needle.lower()))
    found = hit.groupBy("kind", F.lower("value").alias("folded")).agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n"))
    return found.select("kind", "value", "n").orderBy(F.desc("n"), F.length("value"), "value", "kind").limit(limit)


def search_documents(docs: DataFrame) -> DataFrame:
    """The content-free projection of canonical documents: what an index may show without their text."""
    have = set(docs.columns)
    c = lambda name, kind="string": F.col(name) if name in have else F.lit(None).cast(kind)
    extra = lambda k: F.col("extra")[k] if "extra" in have else F.lit(None).cast("string")
    title = F.coalesce(c("title"), c("name"), extra("subject"), extra("channel_label"), c("conversation_id"), F.lit(""))
    return docs.select(
        "_id", F.coalesce(c("kind"), F.lit("message")).alias("kind"), c("provider").alias("provider"), title.alias("title"), F.coalesce(c("sender_name"), F.lit("")).alias("sender_name"),
        F.coalesce(extra("channel_label"), F.lit("")).alias("channel"), c("sender_ref").alias("sender_ref"), c("conversation_id").alias("conversation_id"),
        F.coalesce(c("ts"), c("modified_ts"), c("last_edited"), c("published_ts")).alias("ts"),
        (F.size(F.col("attachments")) > 0 if "attachments" in have else F.lit(False)).alias("has_attachment"),
    )


def result_facets(hits: DataFrame) -> DataFrame:
    """facet, value, n over provider, kind, with_files and year, in one pass."""
    year = F.substring("ts", 1, 4)
    entries = F.array(
        F.struct(F.lit("provider").alias("facet"), F.col("provider").alias("value")),
        F.struct(F.lit("kind").alias("facet"), F.coalesce("kind", F.lit("message")).alias("value")),
        F.struct(F.lit("with_files").alias("facet"), F.when(F.col("has_attachment"), "true").alias("value")),
        F.struct(F.lit("year").alias("facet"), F.when(year.rlike("^[0-9]{4}$"), year).alias("value")),
    )
    return hits.select(F.explode(entries).alias("e")).select("e.*").where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def stemmed(term: str) -> Column:
    return stem(F.lit(term.lower()))
