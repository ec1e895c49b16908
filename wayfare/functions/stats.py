"""Median helpers: exact lower median (an input element) or a bounded-memory sketch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def median_disc(col: str, approx: bool = False, accuracy: int = 10000) -> Column:
    """Lower median, no interpolation.

    exact:  ``percentile_disc(0.5)`` — keeps a count per distinct value of the
            group (small for day / session counts).
    approx: ``percentile_approx`` — a fixed-size quantile sketch per group,
            for groups with very many distinct values; returns an input element.
    """
    if approx:
        return F.percentile_approx(F.col(col), 0.5, accuracy)
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{col}`)")


def median_cont(col: str, approx: bool = False, accuracy: int = 10000) -> Column:
    """Interpolated median (exact ``percentile``) or the sketch when ``approx``."""
    if approx:
        return F.percentile_approx(F.col(col), 0.5, accuracy).cast("double")
    return F.percentile(F.col(col), 0.5)
