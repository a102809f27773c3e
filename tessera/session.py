"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's source to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("tessera", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def build(app: str = "tessera", **conf: str) -> SparkSession:
    """A session with the settings the engine expects: UTC, Arrow on, AQE on."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tessera-work")
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def dealt(df: DataFrame, share: int, *by: str) -> DataFrame:
    """df in parts of about `share` rows (by hash of `by`, if given): a small file may hold very many rows, and by its bytes they would all go to a task or two.

    Counts df, which should be a table or a stash.
    """
    parts = -(-df.count() // share)
    return df.repartition(max(parts, 1), *by) if by or parts > df.rdd.getNumPartitions() else df


def stash(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder (a folder for each value of `by`) and reads it: cuts the lineage, survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stash_evenly(df: DataFrame, name: str, share: int) -> DataFrame:
    """A stash in files of about `share` rows, for costly steps over small rows."""
    rows = stash(df, name)
    parts = dealt(rows, share)
    return rows if parts is rows else stash(parts, name)
