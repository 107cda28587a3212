"""Written tables in the shared folder, for cutting lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Only a local session (as in tests) may leave that setting out; a temporary folder takes its place there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = getattr(shared_dir, "local", None)
        if base is None:
            base = shared_dir.local = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    return f"{base.rstrip('/')}/sparkloom-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of executions in this block go when these end; their rows are in the written table then."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkloom_path = path
    return out


def drop_table(*tables: DataFrame | None) -> None:
    """Delete what materialize() wrote; these tables, and plans over them, must not be read afterwards."""
    for df in tables:
        path = getattr(df, "_sparkloom_path", None)
        if path is None:
            continue
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where.getParent(), True)


def write_shared(uri: str, data: bytes) -> None:
    """Write a whole file in the shared folder at once; a retried task replaces it by the same content.

    Folders without a scheme or with file: are written directly, others through Arrow's file systems.
    """
    if "://" in uri and not uri.startswith("file:"):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(path) as f:
            f.write(data)
        return
    path = uri.removeprefix("file://").removeprefix("file:")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


def read_shared(uri: str) -> bytes:
    """A whole file of the shared folder."""
    if "://" in uri and not uri.startswith("file:"):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(path) as f:
            return f.read()
    with open(uri.removeprefix("file://").removeprefix("file:"), "rb") as f:
        return f.read()
