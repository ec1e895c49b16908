"""Skew-safe running aggregates per key ("prefix scans").

Many journey analyses need, for every row, an aggregate over the *earlier*
rows of the same user: how many sessions started before this conversion,
when was the previous conversion, which session index is this.  A plain
``Window.partitionBy(user).orderBy(ts)`` puts all rows of one user into one
task; with bot-like users holding a large share of the data that task never
finishes.

``running_aggregate`` splits each key into time buckets:

1. inside a (key, bucket) partition a window computes the in-bucket prefix;
2. per (key, bucket) totals (a map-side combined aggregation) get an
   exclusive prefix over buckets — a window over at most #buckets rows per
   key (one per hour with rows for the default width);
3. the bucket offset is joined back on (key, bucket).

The largest window partition is therefore one key's rows within one bucket,
an hour by default, so that a key active on a single day is split too (tune
``bucket_micros`` for the data); the full-size shuffle is the
one by (key, bucket), the totals branch shuffles pre-aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
HOUR_MICROS = 3_600_000_000
DEFAULT_BUCKET_MICROS = HOUR_MICROS

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def running_aggregate(df: DataFrame, keys: list[str], ts: str, value: str | Column,
                      out: str | list[str], agg: str = "sum", frame: str | list[str] = "le",
                      tiebreak: list[str] | None = None,
                      bucket_micros: int = DEFAULT_BUCKET_MICROS) -> DataFrame:
    """Add column(s) ``out`` = agg(value) over rows of the same key ordered by ``ts``.

    frame (one per output):
      ``le``      rows with ts <= current ts (peers with equal ts included)
      ``lt``      rows with ts <  current ts
      ``rows_lt`` rows strictly before the current row in (ts, *tiebreak) order
    For ``sum`` the result is 0 when nothing precedes; for ``max``/``min`` NULL.

    The bucket totals form a second branch of at most one row per key and
    bucket.  Column pruning narrows that branch to (key, bucket, value), so
    it reads its input again instead of reusing the window's shuffle — the
    price of keeping every window partition bounded.
    """
    if agg not in _AGG:
        raise ValueError(f"agg must be one of {list(_AGG)}")
    outs = [out] if isinstance(out, str) else list(out)
    frames = [frame] * len(outs) if isinstance(frame, str) else list(frame)
    fn = _AGG[agg]
    val = F.col(value) if isinstance(value, str) else value
    b, v = "_rb_bucket", "_rb_value"
    base_cols = df.columns
    work = df.select("*", F.floor(F.col(ts) / F.lit(bucket_micros)).cast("long").alias(b), val.alias(v))

    part = Window.partitionBy(*keys, b)
    ins, in_cols = [], []
    for i, fr in enumerate(frames):
        if fr == "le":
            w = part.orderBy(F.col(ts)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        elif fr == "lt":
            w = part.orderBy(F.col(ts)).rangeBetween(Window.unboundedPreceding, -1)
        elif fr == "rows_lt":
            w = part.orderBy(F.col(ts), *[F.col(c) for c in (tiebreak or [])]) \
                .rowsBetween(Window.unboundedPreceding, -1)
        else:
            raise ValueError("frame must be le, lt or rows_lt")
        ins.append(f"_rb_in{i}")
        in_cols.append(fn(F.col(v)).over(w).alias(ins[-1]))
    work = work.select("*", *in_cols)          # one Window node, one analysis

    totals = work.groupBy(*keys, b).agg(fn(F.col(v)).alias("_rb_tot"))
    wb = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, b, fn(F.col("_rb_tot")).over(wb).alias("_rb_before"))

    joined = work.join(totals, on=[*keys, b], how="inner")
    outs_cols = []
    for o, c in zip(outs, ins):
        if agg == "sum":
            res = F.coalesce(F.col("_rb_before"), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))
        elif agg == "max":
            res = F.greatest(F.col("_rb_before"), F.col(c))
        else:
            res = F.least(F.col("_rb_before"), F.col(c))
        outs_cols.append(res.alias(o))
    return joined.select(*[F.col(c) for c in base_cols if c not in outs], *outs_cols)
