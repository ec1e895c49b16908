"""Data diagnostics run before building an analysis: coverage, names, types and formats of parameters.

``param_coverage`` asks after known columns.  The others start from the nested
array itself, so they also show names that nobody expected, a name that comes
in two types, a date that comes in two formats:

* ``param_names``    names by event, how often, in which type slots;
* ``param_formats``  formats of the values of every name;
* ``param_samples``  frequent values of every name, from a mergeable sketch.

The array is exploded once, narrow, and everything is combined map-side.  A
format keeps its digits and folds letters, so there are far fewer formats than
values; what ``param_samples`` holds for a name is bounded by the sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = ("string", "int", "float", "double")


def param_coverage(events: DataFrame, params: list[str], by: list[str] | None = None) -> DataFrame:
    """Per group and parameter: events, events carrying a value, coverage %.

    One aggregation pass computes every parameter's non-null count; ``stack``
    turns the wide row into (param, with_value) rows."""
    by = by or []
    aggs = [F.count(F.lit(1)).alias("events")] + [F.count_if(F.col(p).isNotNull()).alias(f"_nn_{i}")
                                                  for i, p in enumerate(params)]
    wide = events.groupBy(*by).agg(*aggs)
    stack = ", ".join(f"'{p}', _nn_{i}" for i, p in enumerate(params))
    long = wide.select(*by, "events", F.expr(f"stack({len(params)}, {stack}) AS (param, with_value)"))
    return long.withColumn("coverage_pct", F.round(F.col("with_value") / F.col("events") * 100, 2)) \
        .select(*by, "param", "events", "with_value", "coverage_pct")


def slots_of(raw: DataFrame, params: str = "event_params") -> list[str]:
    """The type slots that the export's value struct has."""
    fields = raw.select(F.col(params)).schema[0].dataType.elementType["value"].dataType.names
    return [s for s in SLOTS if f"{s}_value" in fields]


def _entries(raw: DataFrame, by: list[str], params: str) -> DataFrame:
    """One row a parameter of an event: the groups, ``param``, one column a slot, and ``nth`` occurrence of its key."""
    slots = slots_of(raw, params)
    nth = F.transform(F.col(params), lambda p, i: F.struct(
        p["key"].alias("key"), p["value"].alias("value"),
        F.size(F.filter(F.slice(F.col(params), 1, i), lambda q: q["key"] == p["key"])).alias("nth")))
    return (raw.select(*by, F.explode(nth).alias("p"))
            .select(*by, F.col("p.key").alias("param"), F.col("p.nth").alias("nth"),
                    *[F.col(f"p.value.{s}_value").alias(s) for s in slots]))


def _values(raw: DataFrame, params: str) -> DataFrame:
    """(param, slot, value, n): every distinct value as text and how often it comes, summed map-side by a hash."""
    slots = slots_of(raw, params)
    # the outer explode infers no filter on the array, which planning would unfold through the export's projections
    e = raw.select(F.explode_outer(params).alias("p")).select(F.col("p.key").alias("param"), *[F.col(f"p.value.{s}_value").alias(s) for s in slots])
    stack = ", ".join(f"'{s}', CAST({s} AS STRING)" for s in slots)
    return (e.select("param", F.expr(f"stack({len(slots)}, {stack}) AS (slot, value)")).filter(F.col("value").isNotNull())
            .groupBy("param", "slot", "value").agg(F.count(F.lit(1)).alias("n")))


def param_names(raw: DataFrame, by: list[str] | None = None, params: str = "event_params") -> DataFrame:
    """Per group and name: events of the group, events with the name, coverage %, values by type slot,
    empty strings, entries without any value, entries with several, and repetitions within an event."""
    by = by or ["event_name"]
    slots = slots_of(raw, params)
    e = _entries(raw, by, params)
    filled = sum((F.col(s).isNotNull().cast("int") for s in slots), F.lit(0))
    found = e.groupBy(*by, "param").agg(
        F.count_if(F.col("nth") == 0).alias("with_name"),
        *[F.count(s).alias(f"{s}_values") for s in slots],
        F.count_if(F.col("string") == "").alias("empty_strings"), F.count_if(filled == 0).alias("without_value"),
        F.count_if(filled > 1).alias("several_values"), F.count_if(F.col("nth") > 0).alias("repeated"))
    totals = raw.groupBy(*by).agg(F.count(F.lit(1)).alias("events"))
    same = [found[k].eqNullSafe(totals[k]) for k in by]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return (found.join(totals, on).select(
        *[found[k] for k in by], "param", "events", "with_name", F.round(F.col("with_name") / F.col("events") * 100, 2).alias("coverage_pct"),
        *[f"{s}_values" for s in slots], "empty_strings", "without_value", "several_values", "repeated"))


def format_of(value: Column) -> Column:
    """Format of a text: every digit a 9, every run of letters an a, the rest as it is (``2024-05-01`` is 9999-99-99)."""
    return F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]", "9")


def param_formats(raw: DataFrame, top: int | None = None, params: str = "event_params", max_chars: int = 80) -> DataFrame:
    """Per name, type slot and format: values, share % of the slot's values, least and greatest value.

    ``top`` keeps the most frequent formats of a name and slot (ties by format); formats are cut at ``max_chars``.
    The format is made once for each distinct value, and only those are sorted for the least and greatest."""
    formatted = _values(raw, params).withColumn("format", F.substring(format_of(F.col("value")), 1, max_chars))
    found = formatted.groupBy("param", "slot", "format").agg(
        F.sum("n").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))
    if top is None:
        found = found.join(found.groupBy("param", "slot").agg(F.sum("n").alias("total")), ["param", "slot"])
    else:                                       # the ranking's window has the total too: the events are read once
        from pyspark.sql import Window
        w = Window.partitionBy("param", "slot")
        found = found.select("*", F.row_number().over(w.orderBy(F.col("n").desc(), "format")).alias("rank"), F.sum("n").over(w).alias("total"))
        found = found.filter((F.col("rank") <= top) & F.col("param").isNotNull())
    return found.select(
        "param", "slot", "format", F.col("n").alias("values"), F.round(F.col("n") / F.col("total") * 100, 2).alias("share_pct"),
        "least", "greatest")


def sample_sketches(raw: DataFrame, by: list[str] | None = None, params: str = "event_params", tracked: int = 1000) -> DataFrame:
    """(by, param, sketch): a sketch of at most ``tracked`` frequent values for each group; sketches merge."""
    slots = slots_of(raw, params)
    e = _entries(raw, by or [], params)
    text = F.coalesce(*[F.col(s).cast("string") for s in slots])
    return (e.withColumn("value", text).filter(F.col("value").isNotNull()).groupBy(*(by or []), "param")
            .agg(F.expr(f"approx_top_k_accumulate(value, {tracked})").alias("sketch")))


def param_samples(sketches: DataFrame, k: int = 5, by: list[str] | None = None, tracked: int = 1000) -> DataFrame:
    """(by, param, value, n): the ``k`` most frequent values of every name from merged sketches.

    A name with fewer distinct values than three quarters of ``tracked`` is counted exactly; beyond, a
    count may lack at most about 3.5 n / ``tracked`` of the name's n values."""
    merged = sketches.groupBy(*(by or []), "param").agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    return (merged.select(*(by or []), "param", F.explode(F.expr(f"approx_top_k_estimate(sketch, {k})")).alias("t"))
            .select(*(by or []), "param", F.col("t.item").alias("value"), F.col("t.count").alias("n")))
