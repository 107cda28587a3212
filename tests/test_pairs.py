from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom import workload
from sparkloom.operators import blocks, identity, insights
from tests import oracle


def messages(spark):
    rows = [(f"g{k % 7}", k * k % 23, f"2024-01-{1 + k % 28:02d} 00:00:00", k) for k in range(300)]
    rows += [rows[5], ("g1", 3, "2024-02-01 00:00:00", 900), ("g1", 4, "2024-02-01 00:00:00", 900), ("g1", None, "2024-02-01 00:00:00", 901), (None, 4, "2024-02-01 00:00:00", 902)]
    return rows, spark.createDataFrame(rows, "conversation_id string, sender_ref long, ts string, _id long").withColumn("ts", F.to_timestamp("ts"))


@pytest.mark.parametrize("how", [True, False])
@pytest.mark.parametrize("read", [blocks.READ, 20])
def test_meetings_are_interactions_counted(spark, monkeypatch, how, read):
    monkeypatch.setattr(blocks, "READ", read)
    rows, docs = messages(spark)
    met = {(g, r) for g, r, *_ in rows if g is not None and r is not None}
    want = {(min(r, o), max(r, o), ts, k) for g, r, ts, k in rows if g is not None and r is not None for h, o in met if h == g and o != r}
    n, last = Counter(w[:2] for w in want), {}
    for a, b, ts, _ in want:
        last[a, b] = max(last.get((a, b), ""), ts)
    have = insights.meetings(docs, blocks=how).withColumn("last", F.date_format("last", "yyyy-MM-dd HH:mm:ss")).collect()
    assert sorted(map(tuple, have)) == sorted((a, b, k, last[a, b]) for (a, b), k in n.items())
    often = insights.meetings(docs, last=False, least=12, blocks=how).collect()
    assert sorted(map(tuple, often)) == sorted((a, b, k) for (a, b), k in n.items() if k >= 12)


def test_pairs_are_not_made_one_by_one(spark):
    docs = spark.range(3000).select(F.lit("g").alias("conversation_id"), (F.col("id") % 3).alias("sender_ref"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("_id"))
    met = insights.meetings(docs)
    assert "Join" in met._jdf.queryExecution().optimizedPlan().toString() and sorted(r["n"] for r in met.collect()) == [2000] * 3
    assert blocks.sizes(docs.selectExpr("conversation_id AS g", "sender_ref AS r").distinct()) == (3, 3, 3)


def test_advisory_edges_come_from_tiles_of_dense_contacts(spark, sf, monkeypatch):
    monkeypatch.setattr(blocks, "dense", lambda members, paths: True)
    have = workload.advisory_edges(spark, sf)
    assert "ArrowPython" in str(have._jdf.queryExecution()) or "InArrow" in str(have._jdf.queryExecution())
    oracle.assert_same(have, oracle.connect(sf), workload.ORACLES["advisory_edges"])


def test_dense_contacts_are_not_made_pair_by_pair(spark, tmp_path, monkeypatch):
    """Who met whom is never a table of pairs, and the edges are those of the SQL."""
    e = spark.range(6000).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + 3600 * (id * id % 211)) AS ts", "id * 7919 % 307 AS user_id", "'x' AS event_type")
    e = e.withColumn("user_id", F.when(F.col("event_id") % 97 > 0, F.col("user_id")))
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    written, materialize = [], insights.materialize
    monkeypatch.setattr(insights, "materialize", lambda df, name="table": written.append(name) or materialize(df, name))
    monkeypatch.setattr(insights, "meetings", None)
    con = oracle.connect(str(tmp_path))
    for name in ("advisory_edges", "hidden_introducer"):
        oracle.assert_same(workload.QUERIES[name](spark, str(tmp_path)), con, workload.ORACLES[name])
    assert "met" not in written and con.sql(workload.ORACLES["advisory_edges"]).fetchall()


@pytest.mark.parametrize("read", [blocks.READ, 20])
@pytest.mark.parametrize("size", [None, 64])
def test_tiles_of_groups_are_those_of_the_pairs(spark, monkeypatch, read, size):
    monkeypatch.setattr(blocks, "READ", read)
    monkeypatch.setattr(blocks, "LOOK", 16)
    rows = [(f"g{k % 61}", k * k % 397) for k in range(1500)] + [("g1", None), (None, 3)]
    docs = spark.createDataFrame(rows, "conversation_id string, sender_ref long")
    groups = docs.dropna().selectExpr("conversation_id AS g", "sender_ref AS r").distinct()
    want = {(a, b) for g, a in rows for h, b in rows if g == h and g is not None and None not in (a, b) and a < b}
    tiles = blocks.tiles_of_groups(groups, *blocks.sizes(groups)[:2], size)
    assert set(map(tuple, blocks.linked_pairs(tiles).collect())) == want and sum(k if p != q else k // 2 for (p, q), k in tiles.links.items()) == len(want)
    degree = Counter(x for ab in want for x in ab)
    assert 0 < tiles.paths() <= sum(n * (n - 1) // 2 for n in degree.values())


def test_hidden_pairs_of_given_ends_without_counts(spark):
    docs = spark.range(1500).selectExpr("concat('g', id % 61) AS conversation_id", "id * id % 397 AS sender_ref")
    ends = spark.range(0, 400, 3)
    whole = sorted(map(tuple, insights.hidden_in_groups(docs, blocks=False).collect()))
    assert whole == sorted(map(tuple, insights.hidden_in_groups(docs, blocks=True).collect())) and {r[2] >= insights.SURE for r in whole} == {True, False}
    few = [(r[0], r[1], r[3]) for r in whole if r[0] % 3 == r[1] % 3 == 0]
    for how in (True, False):
        have = insights.hidden_in_groups(docs, evidence=False, blocks=how, ends=ends, counts=False)
        assert sorted(map(tuple, have.collect())) == few and few


def test_events_with_nulls_and_copies_as_in_the_sql(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    odd = e.limit(40).withColumn("user_id", F.when(F.col("event_id") % 3 > 0, F.col("user_id"))).withColumn("event_type", F.when(F.col("event_id") % 5 > 0, F.col("event_type")))
    more = e.where("event_id < 60").withColumn("user_id", F.col("user_id") + 1)
    e.unionByName(odd).unionByName(more).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = oracle.connect(str(tmp_path))
    for name in ("interaction_pairs", "interaction_stats", "dormant_pairs"):
        oracle.assert_same(workload.QUERIES[name](spark, str(tmp_path)), con, workload.ORACLES[name])


def test_shared_contacts_by_tiles_are_those_of_the_join(spark):
    pairs = spark.range(900).selectExpr("cast(least(id % 41, id * id % 37) as string) AS a", "cast(greatest(id % 41, id * id % 37) as string) AS b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").where("a <> b")
    have, want = (insights.hidden_introducers(pairs, blocks=how) for how in (True, False))
    rows = sorted(map(tuple, have.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) > 100 and max(len(r[4]) for r in rows) == 5
    few = insights.hidden_introducers(pairs, least=3, evidence=False, blocks=True)
    assert sorted(map(tuple, few.collect())) == [r[:4] for r in rows if r[2] >= 3]
    assert blocks.dense(9000, 180_000_000_000) and not blocks.dense(10_000_000, 5_000_000_000)


@pytest.mark.parametrize("how", [True, False])
@pytest.mark.parametrize("read", [blocks.READ, 20])
def test_cooccurrence_at_bucket_ends(spark, monkeypatch, how, read):
    monkeypatch.setattr(blocks, "READ", read)
    rows = [(f"g{k % 2}", k * 7 % 29, k * k * 13 % 4000) for k in range(120)] + [("g0", 50, 600), ("g0", 51, 1200), ("g0", 52, 1201)]
    docs = spark.createDataFrame(rows, "conversation_id string, sender_ref long, t long").withColumn("ts", F.timestamp_seconds("t"))
    want = {(min(r, o), max(r, o)) for g, r, t in rows for h, o, u in rows if g == h and r != o and abs(t - u) <= 600}
    have = list(map(tuple, identity.cooccurrence_pairs(docs, 600, blocks=how).collect()))
    assert sorted(have) == sorted(want) and (50, 51) in want and (50, 52) not in want


@pytest.mark.parametrize("read", [blocks.READ, 40])
@pytest.mark.parametrize("seconds", [600, 4 * 10**12])
def test_cooccurrence_sends_senders_once_however_many_blocks(spark, monkeypatch, read, seconds):
    """Each sender of a bucket is written twice, not once a block, and pairs are not shuffled; times before 1970 and long buckets too."""
    monkeypatch.setattr(blocks, "READ", read)
    rows = [(f"g{k % 3}" if k % 5 else None, k * k % 101 if k % 7 else None, k * k * 131 % 40000 - 20000) for k in range(900)]
    docs = spark.createDataFrame(rows, "conversation_id string, sender_ref long, t long").withColumn("ts", F.timestamp_seconds("t"))
    written, write = [], blocks.near_files
    monkeypatch.setattr(blocks, "near_files", lambda *a: written.append(write(*a)) or written[0])
    out = identity.cooccurrence_pairs(docs, seconds, blocks=True)
    said = [(g or str(r), r, t) for g, r, t in rows if r is not None]
    want = {(min(r, o), max(r, o)) for g, r, t in said for h, o, u in said if g == h and r != o and abs(t - u) <= seconds}
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "Generate" not in plan and "Aggregate" not in plan
    _, folder, files, parts = written[0]
    assert (parts > 1) == (read == 40) and len({b for _, b in files}) == 11
    sent = sum(blocks.pa.ipc.open_file(blocks.read_shared(f"{folder}/{s}-{b}")).read_all().num_rows for s, b in files)
    assert sent == 2 * len({(g, r, t // seconds) for g, r, t in said})
