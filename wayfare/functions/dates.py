"""Date parsing and day arithmetic with explicit semantics.

* ``parse_multi_date`` tries formats in order and yields NULL when none
  fits (``try_to_date``; plain ``to_date`` raises under ANSI mode).
* ``elapsed_days`` counts whole 24 h periods between two epoch-microsecond
  columns (a 23 h gap over midnight is 0 days).
* ``calendar_days`` counts date boundaries (``datediff``: the same 23 h gap
  over midnight is 1 day).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def parse_multi_date(col: Column, formats: list[str]) -> Column:
    return F.coalesce(*[F.try_to_date(col, f) for f in formats])


def yyyymmdd_to_date(col: Column) -> Column:
    return F.to_date(col, "yyyyMMdd")


def elapsed_days(later: str, earlier: str) -> Column:
    """Whole days between two epoch-microsecond columns, truncating toward 0."""
    return F.expr(f"(`{later}` - `{earlier}`) div {MICROS_PER_DAY}")


def calendar_days(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)


def micros_of_ntz(name: str) -> Column:
    """Epoch micro-seconds of a TIMESTAMP_NTZ column, independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
