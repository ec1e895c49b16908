"""Sinks: materialised tables and models in the shared warehouse folder.

``CREATE OR REPLACE TABLE ... AS SELECT`` becomes a new snapshot folder and a
commit: an empty file whose name holds a version and the snapshot.  Readers
take the highest version, so

* a failing write leaves the table as it was,
* a table may be rewritten from itself,
* a reader that has planned an older snapshot keeps it: the last ``KEEP``
  snapshots stay, older ones are deleted after a commit.

One writer a table at a time is assumed.  A folder without commits (a plain
table, a stream's sink) is read as it is.  Re-reading the written table is
also how long pipelines cut lineage (a lost executor then recomputes from the
table, not from the raw scan).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from wayfare.sources import files

KEEP = 2
COMMITS = "_commits"


def warehouse_dir(spark: SparkSession, name: str) -> str:
    """Folder under the cluster's shared checkpoint location (never machine-local)."""
    from wayfare.session import ensure_checkpoint_dir
    base = spark.conf.get("wayfare.warehouse.dir", None) or ensure_checkpoint_dir(spark)
    return os.path.join(base.rstrip("/"), "wayfare-tables", name)


def commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, snapshot folder) of every commit, oldest first."""
    out = []
    for e in files.entries(spark, f"{path}/{COMMITS}"):
        version, _, snapshot = e.name.partition(".")
        if version.isdigit() and snapshot:
            out.append((int(version), f"{path}/{snapshot}"))
    return sorted(out)


def current(spark: SparkSession, path: str) -> str:
    """Folder of the table's present snapshot (the folder itself where there is no commit)."""
    path = path.rstrip("/")
    known = commits(spark, path)
    return known[-1][1] if known else path


def _replace(spark: SparkSession, path: str, write, keep: int = KEEP) -> str:
    """Lets ``write(folder)`` fill a new snapshot, commits it and drops old ones; returns its folder."""
    path = path.rstrip("/")
    snapshot = f"snapshot-{uuid.uuid4().hex}"
    try:
        write(f"{path}/{snapshot}")
    except BaseException:
        files.delete(spark, f"{path}/{snapshot}")
        raise
    known = commits(spark, path)
    version = known[-1][0] + 1 if known else 1
    if not files.create_new(spark, f"{path}/{COMMITS}/{version:010d}.{snapshot}"):
        raise OSError(f"version {version} of {path} was committed by another writer")
    for old, folder in known[:max(0, len(known) - keep + 1)]:
        files.delete(spark, f"{path}/{COMMITS}/{old:010d}.{folder.rsplit('/', 1)[1]}")
        files.delete(spark, folder)
    return f"{path}/{snapshot}"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, keep: int = KEEP) -> DataFrame:
    """Replaces the table at ``path`` by ``df`` and reads it back; ``df`` may read the table itself."""
    def write(folder: str) -> None:
        w = df.write
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(folder)
    return df.sparkSession.read.parquet(_replace(df.sparkSession, path, write, keep))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))


def save_model(model, path: str, spark: SparkSession | None = None) -> str:
    """Replaces the model at ``path`` the same way; returns the folder of the saved one."""
    spark = spark or SparkSession.getActiveSession()
    return _replace(spark, path, lambda folder: model.write().save(folder))


def load_model(path: str, spark: SparkSession | None = None):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(current(spark or SparkSession.getActiveSession(), path))


def write_flat_events(events: DataFrame, path: str) -> DataFrame:
    """Batch twin of the streaming flat-event sink: one table partitioned by date."""
    return write_table(events, path, partition_by=["event_date"])


def read_flat_events(spark: SparkSession, path: str, period: tuple[str, str] | None = None,
                     since: str | None = None) -> DataFrame:
    """Flat event table with the date bounds applied to the partition column, so
    whole date directories are skipped before any file is opened."""
    from pyspark.sql import functions as F
    path = current(spark, path)
    df = spark.read.option("basePath", path).parquet(path)
    # partition discovery types yyyyMMdd as an integer; the event view keeps a string
    df = df.withColumn("event_date", F.col("event_date").cast("string"))
    lo = period[0] if period else since
    if lo:
        df = df.filter(F.col("event_date") >= lo)
    if period:
        df = df.filter(F.col("event_date") <= period[1])
    return df
