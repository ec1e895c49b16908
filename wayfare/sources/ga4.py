"""Reader for a GA4-style export: nested ``event_params`` and date shards.

Two layouts are read:

* **daily tables**, as the export lies: one folder (or file) a day named
  ``events_YYYYMMDD``, and ``events_intraday_YYYYMMDD`` beside them while a
  day is still filling.  Names are listed and bounded before any table is
  opened, and a row's shard is taken from the path of its file;
* one table **partitioned** by a shard column (``shard=yyyyMMdd``), whose
  bounds are partition filters.

Either way a bounded period prunes whole folders before any file is opened.

* bounded scan:     ``start`` and ``end`` (BETWEEN, inclusive)
* open-ended scan:  ``start`` only (>=).  Only shards named by the eight digits
  of a calendar day are read: ``intraday_...`` would pass a text comparison
  with a date, and the day would count twice.
* late-hit guard:   the logical ``event_date`` is filtered as well, because
  an event can land in the next day's shard.

Bounds on an input that has neither daily tables nor a shard column raise:
the shard bound would otherwise be lost without a word.
"""

from __future__ import annotations

import datetime as _dt
import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.params import DEFAULT_SPEC, flatten_events
from wayfare.sources import files

#: What tells two hits of one instant apart (the batch columns where the export has them).
IDENTITY = ("user_pseudo_id", "event_timestamp", "event_name", "event_params", "batch_page_id", "batch_ordering_id",
            "batch_event_index")
KEEP = ("user_pseudo_id", "event_timestamp", "event_date", "event_name", "event_value_in_usd")
PREFIX = "events_"


class Day(NamedTuple):
    shard: str
    path: str
    intraday: bool


def _is_day(digits: str) -> bool:
    try:
        _dt.datetime.strptime(digits, "%Y%m%d")
    except ValueError:
        return False
    return True


def _root(path: str, prefix: str) -> str:
    """``path`` may be the folder of the daily tables or the wildcard over them."""
    return re.sub(rf"/?{re.escape(prefix)}\*$", "", path.rstrip("/")) or "/"


def daily_tables(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                 intraday: bool = False, prefix: str = PREFIX) -> list[Day]:
    """The daily tables in ``path`` within the bounds, by day.

    ``intraday`` adds the still filling table of a day that has no daily one
    yet; a day that has both is read once, from the daily table."""
    named = re.compile(rf"{re.escape(prefix)}(intraday_)?([0-9]{{8}})(\.[A-Za-z0-9.]+)?")
    found: dict[str, Day] = {}
    for e in files.entries(spark, _root(path, prefix)):
        m = named.fullmatch(e.name)
        if not m or not _is_day(m.group(2)) or (m.group(3) and e.is_folder):
            continue
        day = Day(m.group(2), e.path, bool(m.group(1)))
        if (start is not None and day.shard < start) or (end is not None and day.shard > end) or (day.intraday and not intraday):
            continue
        if day.shard not in found or found[day.shard].intraday:
            found[day.shard] = day
    return [found[s] for s in sorted(found)]


def read_tables(spark: SparkSession, days: list[Day], shard_col: str = "shard", prefix: str = PREFIX,
                merge_schema: bool = False) -> DataFrame:
    """Rows of the given daily tables with their shard, read from each file's path.

    ``merge_schema`` unites the columns of tables that differ (an export gains
    columns over time); without it the newest table's columns are read."""
    reader = spark.read
    if merge_schema:
        reader = reader.option("mergeSchema", "true")
    else:
        reader = reader.schema(spark.read.parquet(days[-1].path).schema)
    shard = F.regexp_extract(F.col("_metadata.file_path"), rf"^.*/{re.escape(prefix)}(?:intraday_)?([0-9]{{8}})", 1)
    return reader.parquet(*[d.path for d in days]).withColumn(shard_col, shard)


def read_daily(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
               shard_col: str = "shard", intraday: bool = False, prefix: str = PREFIX,
               merge_schema: bool = False) -> DataFrame:
    """Rows of the daily tables within the bounds; none if no day lies within, an error if there is no daily table at all."""
    days = daily_tables(spark, path, start, end, intraday, prefix)
    if days:
        return read_tables(spark, days, shard_col, prefix, merge_schema)
    every = daily_tables(spark, path, intraday=True, prefix=prefix)
    if not every:
        raise ValueError(f"no table {prefix}YYYYMMDD in {path}")
    return read_tables(spark, every[-1:], shard_col, prefix).filter(F.lit(False))


def write_daily(raw: DataFrame, path: str, shard_col: str = "shard", prefix: str = PREFIX) -> list[str]:
    """Writes one table a day; days that ``raw`` holds are replaced, others stay.  Returns the days.

    All days are written by one job beside the tables and then put in place by renaming."""
    import uuid
    spark, path = raw.sparkSession, path.rstrip("/")
    beside = f"{path}/_beside-{uuid.uuid4().hex}"
    raw.withColumn("_day", F.col(shard_col)).drop(shard_col).write.partitionBy("_day").parquet(beside)
    days = []
    for e in files.entries(spark, beside):
        if e.name.startswith("_day="):
            day = e.name.removeprefix("_day=")
            if not _is_day(day) or not re.fullmatch("[0-9]{8}", day):
                raise ValueError(f"{shard_col} {day!r} is no day")
            files.delete(spark, f"{path}/{prefix}{day}")
            files.rename(spark, e.path, f"{path}/{prefix}{day}")
            days.append(day)
    files.delete(spark, beside)
    return days


def guard_dates(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The late-hit guard: the logical date within the bounds as well."""
    if start is not None:
        df = df.filter(F.col("event_date") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("event_date") <= F.lit(end))
    return df


def scan_shards(raw: DataFrame, start: str | None = None, end: str | None = None,
                shard_col: str = "shard", date_guard: bool = True) -> DataFrame:
    df = raw
    if shard_col in raw.columns:
        df = df.filter(F.col(shard_col).cast("string").rlike("^[0-9]{8}$"))
        if start is not None:
            df = df.filter(F.col(shard_col) >= F.lit(start))
        if end is not None:
            df = df.filter(F.col(shard_col) <= F.lit(end))
    elif start is not None or end is not None:
        raise ValueError(f"no column {shard_col!r}: the shard bound cannot be applied")
    return guard_dates(df, start, end) if date_guard else df


def to_flat(raw: DataFrame, spec: dict | None = None) -> DataFrame:
    """Nested export rows -> the flat event view used by every operator."""
    if "event_id" not in raw.columns:
        # stable tie-break for equal timestamps: hash of the whole hit and its place in the batch
        raw = raw.withColumn("event_id", F.xxhash64(*[c for c in IDENTITY if c in raw.columns]))
    # epoch micros -> wall-clock UTC timestamp without a session-zone conversion
    return flatten_events(raw, spec or DEFAULT_SPEC, keep=(*KEEP, "event_id")).withColumn("event_ts", F.expr(
        "timestampadd(MICROSECOND, event_timestamp, TIMESTAMP_NTZ'1970-01-01 00:00:00')"))


def read_export(spark: SparkSession, path: str, start: str | None = None, end: str | None = None,
                spec: dict | None = None, shard_col: str = "shard", intraday: bool = False,
                merge_schema: bool = False) -> DataFrame:
    """The flat event view of an export in either layout, with shard bounds and the late-hit guard."""
    if daily_tables(spark, path, intraday=True):
        raw = read_daily(spark, path, start, end, shard_col, intraday, merge_schema=merge_schema)
        return to_flat(guard_dates(raw, start, end), spec)
    return to_flat(scan_shards(spark.read.parquet(path), start, end, shard_col), spec)
