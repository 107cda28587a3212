"""Ingestion: bronze envelopes to silver tables, as batches or streams, at least once and idempotent.

A table is a folder of versions and a pointer to the current one. A write makes a whole new version and
then moves the pointer, so readers never see half a table, and a repeated batch gives the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.privacy import SEALED_FIELDS, KeyRing, Sealer
from ..functions.text import content_hash
from ..schema import CONTENT_TABLES
from ..sources.normalize import normalize, quarantine


class VersionedTable:
    """A keyed table in shared storage; writes replace it by a new version."""

    KEEP = 2

    def __init__(self, spark: SparkSession, folder: str, name: str, sealer: Sealer | None = None):
        self.spark, self.path, self.sealer = spark, f"{folder.rstrip('/')}/{name}", sealer
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions, oldest first: those whose writer has committed."""
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def stored(self) -> DataFrame | None:
        """The current version as it is stored."""
        have = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{have[-1]}") if have else None

    def read(self) -> DataFrame | None:
        """The current version, sealed fields opened; those that a query leaves out are not decrypted."""
        have = self.stored()
        return have if have is None or self.sealer is None else self.sealer.open(have)

    def replace(self, df: DataFrame) -> None:
        df = df if self.sealer is None else self.sealer.close(df)
        have = self.versions()
        new = (have[-1] if have else 0) + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{new}")
        for old in have[: -self.KEEP + 1]:
            self._fs.delete(self._path(f"{self.path}/v{old}"), True)

    def merge(self, rows: DataFrame, key: str = "_id", order: str = "_ingested") -> None:
        """Latest row per key of what is there and rows; the first time a key came stays."""
        rows = rows.where(F.col(key).isNotNull()).withColumn("created_at", F.col(order))
        old = self.stored()
        if self.sealer is not None:  # what is sealed stays as it is
            rows, old = self.sealer.close(rows), None if old is None else self.sealer.close(old)
        both = rows if old is None else old.unionByName(rows, allowMissingColumns=True)
        w = Window.partitionBy(key)
        best = both.withColumn("_n", F.row_number().over(w.orderBy(F.col(order).desc()))).withColumn("created_at", F.min("created_at").over(w))
        self.replace(best.where("_n = 1").drop("_n"))

    def drop(self) -> None:
        self._fs.delete(self._path(self.path), True)


class Ingest:
    """One workspace's tables below a shared folder, their private fields sealed where a key ring is given."""

    def __init__(self, spark: SparkSession, folder: str, ring: KeyRing | None = None):
        self.spark, self.folder, self.ring = spark, folder, ring

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, self.folder, name, Sealer(self.ring, name) if self.ring and name in SEALED_FIELDS else None)

    def run(self, raw: DataFrame, stamp: int) -> dict[str, int]:
        """Take up one batch of envelopes; stamp orders batches. Returns counts for the run log.

        Envelopes whose id and payload hash are known are skipped before anything is parsed. Those that
        do not parse go to the quarantine table and the others proceed.
        """
        bronze = self.table("raw_artifacts")
        raw = raw.withColumn("payload_hash", F.coalesce("payload_hash", content_hash("payload")))
        known = bronze.read()
        fresh = raw if known is None else raw.join(known.select("raw_id", "payload_hash"), ["raw_id", "payload_hash"], "left_anti")
        fresh = fresh.withColumn("_ingested", F.lit(stamp).cast("bigint")).persist()
        try:
            counts = {"seen": raw.count(), "fresh": fresh.count(), "quarantined": 0}
            if counts["fresh"]:
                bad = quarantine(fresh)
                counts["quarantined"] = bad.count()
                if counts["quarantined"]:
                    self.table("quarantine").merge(bad, "raw_id")
                for name, df in normalize(fresh).items():
                    self.table(name).merge(df.withColumn("_ingested", F.lit(stamp).cast("bigint")).dropDuplicates(["_id"]))
                bronze.merge(fresh, "raw_id")
        finally:
            fresh.unpersist()
        status = "ok" if not counts["quarantined"] else "partial" if counts["quarantined"] < counts["fresh"] else "failed"
        log = self.spark.createDataFrame([(f"run:{stamp}", stamp, status, *counts.values())], "_id string, stamp bigint, status string, seen bigint, fresh bigint, quarantined bigint")
        self.table("ingest_runs").merge(log.withColumn("_ingested", F.col("stamp")))
        return counts

    def stream(self, raw: DataFrame, checkpoint: str):
        """Run over a stream of envelopes till its present end: one batch at a time, each as run() has it."""
        return raw.writeStream.foreachBatch(lambda df, n: self.run(df, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def documents(self) -> DataFrame | None:
        """All content tables as one, in order of time."""
        have = [t for t in (self.table(n).read() for n in CONTENT_TABLES) if t is not None]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), have) if have else None


def conversations(messages: DataFrame) -> DataFrame:
    """Rollup of conversations, recomputed, so that late and repeated messages change nothing but what they should."""
    kinds = F.create_map(*[F.lit(x) for kv in {"slack": "channel", "discord": "channel", "gmail": "email_thread", "whatsapp": "chat", "notion": "workspace"}.items() for x in kv])
    label = F.coalesce(F.col("extra")["channel_label"], F.col("extra")["chat_label"], F.col("extra")["subject"], F.col("conversation_id"))
    return messages.groupBy("provider", "conversation_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("message_count"), F.min_by(label, "ts").alias("label"), F.array_sort(F.collect_set("sender_ref")).alias("member_refs")
    ).withColumn("kind", F.coalesce(kinds[F.col("provider")], F.lit("stream")))


def identities(messages: DataFrame) -> DataFrame:
    """One identity per sender: the longest name, the last address, counts and times recomputed."""
    rows = messages.select("provider", F.col("sender_ref").alias("ref"), F.col("sender_name").alias("name"), "ts", F.nullif(F.col("extra")["sender_email"], F.lit("")).alias("email"), F.nullif(F.col("extra")["sender_phone"], F.lit("")).alias("phone"), (F.col("direction") == "outbound").alias("own"))
    out = rows.where("ref is not null").groupBy("ref", "provider").agg(
        F.max_by("name", F.struct(F.length("name"), F.col("name"))).alias("display_name"), F.max_by("email", F.when(F.col("email").isNotNull(), F.col("ts"))).alias("email"), F.max_by("phone", F.when(F.col("phone").isNotNull(), F.col("ts"))).alias("phone"),
        F.count(F.lit(1)).alias("mention_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max("own").alias("is_self"),
    )
    return out.withColumn("_id", F.col("ref")).withColumn("provider_user_id", F.regexp_replace("ref", "^[^:]*:", ""))


def follow(stream: DataFrame, take, checkpoint: str, mode: str = "append") -> None:
    """Run a stream till its present end, each batch through take(rows); returns when all are taken."""
    stream.writeStream.outputMode(mode).foreachBatch(lambda rows, n: take(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_by_key(events: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """A stream's rows without repeats of a key within the watermark (state is dropped behind it)."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def burst_windows(events: DataFrame, keys: list[str], ts: str = "ts", window: str = "14 days", slide: str = "1 day", threshold: int = 8) -> DataFrame:
    """Sliding event-time windows with many events: for streams and batches alike (an extension of the burst detector)."""
    w = events.withWatermark(ts, "1 day").groupBy(*keys, F.window(ts, window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.where(F.col("n") >= threshold).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def quiet_sessions(events: DataFrame, keys: list[str], ts: str = "ts", gap: str = "90 days") -> DataFrame:
    """Session windows that a silence closed (an extension of the dormancy detector)."""
    s = events.withWatermark(ts, "1 day").groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


