"""The stages against plain versions, and on odd tables."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as C
from sparkloom.llm.common import materialize
from sparkloom.llm.mixing import mix_sources, mixed_rows
from tests.llm.test_operators import brute_components, odd_docs

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = materialize(C.language_id(spark, docs, sf))
    assert one.columns == COLUMNS and docs.count() - one.count() <= 2  # clean documents stay
    two = materialize(C.near_duplicates(spark, one, sf))
    rows = [(r["doc_id"], r["text"]) for r in one.collect()]
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(d for d, _, c in brute_components(rows) if c == d)
    three = materialize(C.mixing(spark, two, sf))
    copies = Counter(r["doc_id"] for r in three.collect())
    assert three.columns == COLUMNS and set(copies) <= {r["doc_id"] for r in two.collect()} and max(copies.values()) <= 3
    words = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert abs(words(three) - words(two)) < 20_000
    four = C.packing(spark, three, sf)
    assert four.where("piece = 0").count() == three.count()
    assert C.run(spark, sf).count() == four.count()


def test_odd_tables(spark, sf):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = C.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    names = Counter(r["doc_id"] for r in kept.collect())
    assert names[10] == 1 and names[11] == 0 and names[3] == 2 and names[None] == 1  # repeated rows: one stays
    assert sum(names.values()) == len(rows) - 2
    for stage in (C.language_id, C.near_duplicates, C.mixing, C.packing):
        assert stage(spark, docs.limit(0), sf).count() == 0
    mixed = C.mixing(spark, docs, sf)
    assert mixed.columns == docs.columns and mixed.where("text is null").count() == 0


def test_extra_columns(spark, sf):
    """Columns of any name pass through; rows that differ in them alone are different rows."""
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "a", 3, 10, 7, "x"), (1, text, "en", "a", 3, 10, 7, "y"), (1, text, "en", "a", 3, 10, 7, "y"), (2, "quite another text", "en", "a", 3, 20, 8, "z"), (3, None, "en", "b", 0, 30, 9, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key int, _copies int, mark string")
    kept = C.near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    got = sorted(tuple(r) for r in kept.collect())
    assert [r[0] for r in got] == [1, 2, 3] and got[0][:7] == rows[0][:7] and got[0][7] in "xy" and got[1:] == sorted(rows[3:])
    assert got == sorted(tuple(r) for r in C.near_duplicates(spark, docs.repartition(3), sf).collect())
    mixed = C.mixing(spark, docs, sf)
    names = Counter(tuple(r) for r in mixed.collect())
    assert mixed.columns == docs.columns and set(names) <= set(rows) and max(names.values()) <= 6


def test_mixing_counts_as_the_operator(spark, sf):
    """The stage's cuts give each document as often as mix_sources takes it, also where documents tie."""
    docs = spark.createDataFrame([(None if i % 3 else i, f"w{' w' * (i % 5)}", "ab"[i % 2], i) for i in range(60)], "doc_id long, text string, source string, n long")
    want = mix_sources(docs).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n")).where("n > 0")
    have = mixed_rows(docs, "doc_id").select("doc_id", "source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(str, want.collect())) == sorted(map(str, have.collect()))
