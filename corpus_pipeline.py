"""The corpus pipeline: language ID, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder as Parquet and rereads them, so a
lost executor repeats at most one stage.

* language ID: learns from the labelled rows of its own input; rows that it rejects (no letter, or far
  from all learned languages) go. ``lang`` keeps its given value.
* near duplicates: of each component of linked texts the row with the smallest doc_id stays (of rows
  that are equal in all columns, one); rows with an empty text are linked with nothing and stay.
* mixing: a row stays as often as the mix takes it: not at all, once, or up to three times.
* packing: one row per piece of each row left; copies of a row are packed as documents of their own.

Null ids, texts, languages and sources are handled as the operators' docstrings say; columns besides
those of ``documents`` pass through the first three stages, whatever their names. Texts are not shuffled
by the second and third stage, but for rows that may have to go as near duplicates.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_table, map_arrow, materialize, read_table
from sparkloom.llm.jaccard import bitmap, jaccard_components, on
from sparkloom.llm.language_id import accepted, fit
from sparkloom.llm.mixing import mixed_rows
from sparkloom.llm.packing import best_fit_pack
from sparkloom.llm.queries import bpe_path


def _name(docs: DataFrame, base: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while base in taken:
        base += "_"
    return base


def _key(docs: DataFrame):
    """A row's key, in order of doc_id with nulls last; rows with one key are the same in all columns."""
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64(*cols).alias("h"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, fit(docs.select(F.col("doc_id").alias("id"), "text", "lang")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key, mark = _name(docs, "key"), _name(docs, "mark")
    keyed = docs.withColumn(key, _key(docs))
    groups = jaccard_components(keyed.select(key, "text"), id_col=key)
    # keys of rows that go, or of which one stays; a bitmap of them lets all other rows pass as they are
    found = groups.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.first("component_id").alias("c"))
    found = materialize(found.where((F.col("c") != F.col("k")) | (F.col("n") > 1)).select("k", (F.col("c") == F.col("k")).alias("stays"), F.xxhash64("k").alias("h")), "found")
    drop_table(groups)
    bits = spark.sparkContext.broadcast(bitmap(found, "h"))

    def rows(marked: bool):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(on(bits.value, b.column(b.num_columns - 1).to_numpy()) == marked))

        hashed = docs.withColumn(mark, F.xxhash64(_key(docs)))
        return map_arrow(hashed, run, hashed.schema).drop(mark)

    some = rows(True)
    some = some.withColumn(key, _key(some))
    go = found.where("not stays").select(F.col("k").alias(key))
    some = some.join(go, key, "left_anti").dropDuplicates([key]).select(*(f"`{c}`" for c in docs.columns))
    return rows(False).unionByName(some)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = _name(docs, "key")
    return mixed_rows(docs.withColumn(key, _key(docs)), id_col=key).drop(key)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # workers that ran the stages before are still there: less memory for each, more time
    return best_fit_pack(docs, bpe_path(), kept=250_000, slice_bytes=1 << 18)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Hashing, models and tokenization can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
