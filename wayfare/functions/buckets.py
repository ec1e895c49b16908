"""Ordered bucketing (searched CASE with first-match-wins semantics)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucketize(col: Column, rules: list[tuple[str, float | None, float | None]],
              else_label: str | None = None) -> Column:
    """``rules`` = [(label, lo, hi)], inclusive bounds, None = open side.

    Rules are evaluated in order, so an earlier rule wins on overlap, exactly
    like a searched CASE.  A NULL input falls through to ``else_label``.
    """
    out = None
    for label, lo, hi in rules:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (col >= F.lit(lo))
        if hi is not None:
            cond = cond & (col <= F.lit(hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    if out is None:
        return F.lit(else_label)
    return out.otherwise(F.lit(else_label)) if else_label is not None else out


# Band definitions used by the reports (label, low, high) — fixed values.
SESSIONS_BANDS = [
    ("0 (same session)", 0, 0), ("1", 1, 1), ("2-3", 2, 3), ("4-7", 4, 7),
    ("8-14", 8, 14), ("15-30", 15, 30), ("31-90", 31, 90),
]
SESSIONS_ELSE = "91+"

DAYS_BANDS = [
    ("0 - Same day", None, 0), ("1 - 1-3 days", 1, 3), ("2 - 4-7 days", 4, 7),
    ("3 - 8-14 days", 8, 14), ("4 - 15-30 days", 15, 30), ("5 - 31-90 days", 31, 90),
]
DAYS_ELSE = "6 - 90+ days"

DEPARTURE_BANDS = [
    ("0 - Dopo la partenza", None, -1), ("1 - Giorno di partenza", 0, 0),
    ("2 - 1-7 giorni", 1, 7), ("3 - 8-30 giorni", 8, 30), ("4 - 31-90 giorni", 31, 90),
    ("5 - 91-180 giorni", 91, 180), ("6 - 181-365 giorni", 181, 365),
]
DEPARTURE_ELSE = "7 - 365+ giorni"
