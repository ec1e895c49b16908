"""Mergeable quantile sketches: one sketch a day and group, merged for any period.

An exact median of a period needs the period's rows.  A KLL sketch of a day's
values keeps a few kilobytes whatever the day holds, and sketches of days merge
into the sketch of their period without another error: write ``daily_sketches``
once a day, ask ``period_summary`` for any period.

Count, sum, least and greatest value are exact.  The median is a value of the
input whose rank among n values is off by at most ``rank_error(k)`` n (with 99 %
confidence); with at most ``k`` values it is the exact lower median.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 800


def rank_error(k: int = K) -> float:
    """Bound on the rank's error as a share of the count (published for KLL sketches; fixed values)."""
    return 2.296 / k ** 0.9723


def daily_sketches(df: DataFrame, keys: list[str], day: str, value: str, k: int = K) -> DataFrame:
    """(keys, day, n, total, least, greatest, sketch) of the whole-numbered non-null values of each group and day."""
    v = F.col(value).cast("long")
    return (df.filter(v.isNotNull()).groupBy(*keys, F.col(day).alias("day"))
            .agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("greatest"),
                 F.expr(f"kll_sketch_agg_bigint(CAST(`{value}` AS BIGINT), {k})").alias("sketch")))


def period_summary(sketches: DataFrame, keys: list[str], since=None, until=None) -> DataFrame:
    """(keys, n, mean, least, greatest, median) over the days ``since`` .. ``until`` (inclusive; None: open)."""
    s = sketches
    if since is not None:
        s = s.filter(F.col("day") >= F.lit(since))
    if until is not None:
        s = s.filter(F.col("day") <= F.lit(until))
    return (s.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("least").alias("least"),
                                 F.max("greatest").alias("greatest"), F.expr("kll_merge_agg_bigint(sketch)").alias("sketch"))
            # a little under the middle: of two middle values the lower one
            .withColumn("median", F.expr("kll_sketch_get_quantile_bigint(sketch, 0.499999999D)")).drop("sketch"))
