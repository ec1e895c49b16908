"""Incremental refresh of the flat event table from the daily tables of an export.

A daily table that is new, rewritten or gone changes the rows of the event
dates it holds (late hits: not only of its own day).  Only these dates are
rebuilt:

1. the listing (names, sizes, times) of every daily table is compared with the
   one that the last refresh recorded;
2. the dates of changed tables, now and at the last refresh, are *touched*;
3. the touched dates are read from all tables that hold them, which the
   record names, and overwrite their partitions (dynamic overwrite); touched
   dates without rows lose their partition;
4. the new record is committed.  A refresh that fails before that is simply
   done again: the same tables count as changed.

The record holds a row a (daily table, event date): days times days of
lateness, the only thing that comes to the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.sources import files, ga4
from wayfare.sources.tables import current, write_table

RECORD = "shard string, signature string, event_date string"


class Refreshed(NamedTuple):
    changed: list[str]        # daily tables that are new, rewritten or gone
    dates: list[str]          # event dates that were rebuilt
    read: list[str]           # daily tables that were read for it


def _dates(spark: SparkSession, days: list[ga4.Day]) -> set[tuple[str, str]]:
    if not days:
        return set()
    rows = ga4.read_tables(spark, days).select("shard", F.coalesce("event_date", F.lit("")).alias("d")).distinct().collect()
    return {(r.shard, r.d) for r in rows}


def _record(spark: SparkSession, path: str) -> DataFrame:
    if not files.exists(spark, path):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).parquet(current(spark, path))


def refresh_flat_events(spark: SparkSession, export: str, table: str, spec: dict | None = None,
                        intraday: bool = False) -> Refreshed:
    """Brings the flat event table at ``table`` (partitioned by ``event_date``) up to date with ``export``.

    ``table`` is a plain folder that only this function writes; its record lies in ``<table>_record``."""
    table = table.rstrip("/")
    days = ga4.daily_tables(spark, export, intraday=intraday)
    now = {d.shard: files.signature(spark, d.path) for d in days}
    old: dict[str, tuple[str, set[str]]] = {}
    for r in _record(spark, f"{table}_record").collect():
        old.setdefault(r.shard, (r.signature, set()))[1].add(r.event_date)
    changed = {s for s in now.keys() | old.keys() if now.get(s) != (old[s][0] if s in old else None)}
    if not changed:
        return Refreshed([], [], [])
    fresh = _dates(spark, [d for d in days if d.shard in changed])
    held: dict[str, set[str]] = {s: dates for s, (_, dates) in old.items() if s not in changed}
    for s in changed & now.keys():
        held[s] = {d for shard, d in fresh if shard == s}
    touched = {d for _, d in fresh} | {d for s in changed & old.keys() for d in old[s][1]}
    touched.discard("-")                                    # what the record says of an empty table
    read = [d for d in days if held[d.shard] & touched]
    if read:
        rows = ga4.read_tables(spark, read).filter(F.coalesce("event_date", F.lit("")).isin(sorted(touched)))
        (ga4.to_flat(rows, spec).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("event_date").parquet(table))
    for d in touched - set().union(*(held[x.shard] for x in read)):
        files.delete(spark, f"{table}/event_date={d or '__HIVE_DEFAULT_PARTITION__'}")
    record = [(s, now[s], d) for s, dates in held.items() for d in (dates or {"-"})]
    write_table(spark.createDataFrame(record, RECORD).coalesce(1), f"{table}_record")
    return Refreshed(sorted(changed), sorted(touched), [d.shard for d in read])
