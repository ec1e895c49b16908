"""Exact summary with interpolated median per group, no group held in one task.

``percentile`` keeps a count per distinct value of each group and merges the
maps of a group in one task: fine for small domains (days, session counts),
not for a money column of a group holding a third of all rows.

``group_summary`` selects the median ranks exactly, by narrowing ranges:

1. rows are reduced to (group, value) -> count, combined map-side;
2. these to (group, value band) -> count, least, greatest value.  A band spans
   1 / ``BANDS_PER_DOUBLING`` of a doubling of the value, so all doubles lie in
   67,000 bands; a running count over a group's bands finds the band of a rank;
3. ``REFINEMENTS`` times the range from that band's least to its greatest value
   is cut into ``SPLITS`` equal buckets, counted, and the rank's bucket becomes
   the range.  A band holds 2^48 doubles at most, a bucket of a bucket 2^16;
4. the values left in the range are ranked.

No window ever orders more than about ``SPLITS`` rows of a group and rank, however
many distinct values lie close together.  A range of one value stays as it is,
so groups with few values pass the refinements as single rows.

Interpolation follows ``percentile``: position p = 0.5 (n - 1),
value = (ceil(p) - p) * v[floor(p)] + (p - floor(p)) * v[ceil(p)].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS_PER_DOUBLING = 16
SPLITS = 1 << 16
REFINEMENTS = 2


def value_band(v: Column) -> Column:
    """Order-preserving band number of a value: by sign and magnitude."""
    size = F.floor(F.log2(F.abs(v)) * BANDS_PER_DOUBLING) + (1 << 20)
    return (F.when(F.isnan(v), F.lit(1 << 30)).when(v == 0, F.lit(0))
            .when(F.abs(v) == float("inf"), F.signum(v) * (1 << 29)).otherwise(F.signum(v) * size)).cast("long")


def _among(counts: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Counted values within the range of each target of their group."""
    a, b = counts.alias("a"), targets.alias("b")
    same = (F.col("a._band") == F.col("b._band")) & F.col("a._v").between(F.col("b._lo"), F.col("b._hi"))
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same).select("b.*", "a._v", "a._c")


def _pick(ranges: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each target's ranges (``_n`` rows each, in ``order``) the one that holds its rank; ``_k`` counts from its start."""
    w = Window.partitionBy(*keys, "_t").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    below = ranges.withColumn("_below", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (below.filter((F.col("_below") <= F.col("_k")) & (F.col("_below") + F.col("_n") > F.col("_k")))
            .withColumn("_k", F.col("_k") - F.col("_below")).drop("_below", "_n", order))


def group_summary(df: DataFrame, keys: list[str], value: str, money: bool = False) -> DataFrame:
    """(keys, n, min, max, total, median) of the non-null values of every group (a NULL key is a group too).

    ``money`` sums in decimals of six places, so the total does not depend on the order of the rows."""
    counts = (df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
              .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_band", value_band(F.col("_v"))))
    amount = F.col("_v").cast("decimal(28,6)") * F.col("_c").cast("decimal(10,0)") if money else F.col("_v") * F.col("_c")
    group = Window.partitionBy(*keys)
    bands = (counts.groupBy(*keys, "_band")
             .agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum(amount).alias("_sum"))
             .select(*keys, "_band", "_n", "_lo", "_hi", F.sum("_n").over(group).alias("n"), F.min("_lo").over(group).alias("min"),
                     F.max("_hi").over(group).alias("max"), F.sum("_sum").over(group).cast("double").alias("total"),
                     F.coalesce(F.sum("_n").over(group.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below")))
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)))
    ranks = F.transform(ranks, lambda r, i: F.struct(i.alias("_t"), (r - F.col("_below")).alias("_k")))
    targets = (bands.withColumn("_r", F.explode(F.filter(ranks, lambda r: (r["_k"] >= 0) & (r["_k"] < F.col("_n")))))
               .select(*keys, "_band", "_lo", "_hi", "n", "min", "max", "total", "_r._t", "_r._k"))
    kept = [*keys, "_band", "_t", "_k", "n", "min", "max", "total"]
    for _ in range(REFINEMENTS):
        place = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SPLITS)
        bucket = F.when(F.col("_lo") == F.col("_hi"), F.lit(0)).otherwise(F.least(place, F.lit(SPLITS - 1))).cast("long")
        found = (_among(counts, targets, keys).groupBy(*kept, bucket.alias("_bucket"))
                 .agg(F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
        targets = _pick(found, keys, "_bucket")
    values = _pick(_among(counts, targets, keys).select(*kept, F.col("_c").alias("_n"), "_v", F.col("_v").alias("_x")), keys, "_x")
    picked = values.groupBy(*keys).agg(
        F.min(F.when(F.col("_t") == 0, F.col("_v"))).alias("_v1"), F.min(F.when(F.col("_t") == 1, F.col("_v"))).alias("_v2"),
        *[F.first(c).alias(c) for c in ("n", "min", "max", "total")])
    pos = (F.col("n") - 1) / 2
    median = F.when(F.col("_v2").isNull() | (F.col("_v1") == F.col("_v2")), F.col("_v1")).otherwise(
        (F.ceil(pos) - pos) * F.col("_v1") + (pos - F.floor(pos)) * F.col("_v2"))
    return picked.select(*keys, "n", "min", "max", "total", median.alias("median"))


def group_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    return group_summary(df, keys, value).select(*keys, F.col("median").alias(out))
