"""Two-audience booking-value comparison and visit roll-ups.

Audiences are ``Column`` predicates over the visitor-segment table (the
dashboard's text templates become Catalyst expressions — no SQL text is
ever assembled).  A visitor can be in both audiences and then counts on
both sides.  Booking values are summed per (visitor, request type, day)
and compared per side and type, over all types, and over the e-commerce
types, with count / min / max / mean / total / exact median.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.stats import median_cont
from wayfare.operators.stats import group_summary

ECOMMERCE_TYPES = ["WBBK", "WBOF.01", "WBOF.02", "WBOF.03", "WEBQ", "WEBQ (ECommerce)", "WEBQ (PriceConfig)"]
TYPE_ORDER = ["ALL", "ALL ECOMMERCE", "WBBK", "WBOF.01", "WBOF.02", "WBOF.03", "WEBQ", "RAQ", "RAB", "SFO"]


def audiences(segments: DataFrame, left: Column, right: Column, common: Column | None = None) -> DataFrame:
    """(side, visitor, day) of both audiences from one pass: a row carries the sides it is in."""
    sides = F.filter(F.array(F.when(left, F.lit("left")), F.when(right, F.lit("right"))), lambda s: s.isNotNull())
    rows = segments if common is None else segments.filter(common)
    return rows.select(F.explode(sides).alias("side"), "visitor_id", "date").distinct()


def booking_values(leads: DataFrame, status: str = "BK") -> DataFrame:
    """Revenue per (visitor, labelled request type, day) of positive booked leads.

    The WEBQ type is labelled with its source; a NULL source gives a NULL
    label (string concatenation with NULL).  The label is computed before
    grouping, so the grouping is on the label, not on the raw type."""
    t = F.col("web_request_type")
    label = F.when(t == "WEBQ", F.concat(t, F.lit(" ("), F.col("webq_source"), F.lit(")"))).otherwise(t)
    return (leads.filter((F.col("booking_status") == status) & (F.col("net_cruise_revenue") > 0))
            .withColumn("_type", label).withColumn("_date", F.to_date("event_timestamp"))
            .groupBy("visitor_id", F.col("_type").alias("web_request_type"), F.col("_date").alias("date"))
            .agg(F.sum("net_cruise_revenue").alias("total_net_cruise_revenue")))


def _report_groups(j: DataFrame) -> DataFrame:
    """Each booking row feeds up to three report groups: its own type, 'ALL'
    and, for e-commerce types, 'ALL ECOMMERCE' — a bounded explode, so one
    aggregation produces all three blocks."""
    t = F.col("web_request_type")
    groups = F.array(
        F.struct(F.lit(0).alias("kind"), t.alias("label"), F.lit(True).alias("keep")),
        F.struct(F.lit(1).alias("kind"), F.lit("ALL").alias("label"), F.lit(True).alias("keep")),
        F.struct(F.lit(2).alias("kind"), F.lit("ALL ECOMMERCE").alias("label"),
                 F.coalesce(t.isin(ECOMMERCE_TYPES), F.lit(False)).alias("keep")))
    return (j.select("side", "visitor_id", "total_net_cruise_revenue",
                     F.explode(F.filter(groups, lambda g: g["keep"])).alias("g"))
            .select("side", F.col("g.kind").alias("_kind"), F.col("g.label").alias("web_request_type"),
                    "visitor_id", "total_net_cruise_revenue"))


def compare_audiences(segments: DataFrame, leads: DataFrame, left: Column, right: Column,
                      common: Column | None = None, median: str = "exact", only: str | None = None) -> DataFrame:
    """Per side and request type (plus 'ALL' and 'ALL ECOMMERCE'): count, min,
    max, mean, total and median booking value; ``only`` keeps one of them
    before anything is aggregated.

    median: ``exact`` (bounded exact selection, ``operators.stats``),
    ``percentile`` (one exact aggregate, a count per distinct value per
    group) or ``approx`` (fixed-size sketch)."""
    segs = audiences(segments, left, right, common)
    vals = booking_values(leads)
    j = segs.join(vals, ["visitor_id", "date"], "inner")    # left join + IS NOT NULL filter
    g = _report_groups(j)
    if only is not None:
        g = g.filter(F.col("web_request_type") == only)
    keys = ["side", "_kind", "web_request_type"]
    v = F.col("total_net_cruise_revenue")
    if median == "exact":
        s = group_summary(g, keys, "total_net_cruise_revenue", money=True)
        out = s.select(*keys, F.col("n").alias("count"), F.col("min").alias("min_booking_value"),
                       F.col("max").alias("max_booking_value"), (F.col("total") / F.col("n")).alias("mean_booking_value"),
                       F.col("total").alias("total_booking_value"), F.col("median").alias("median_booking_value"))
    else:
        out = g.groupBy(*keys).agg(
            F.count("visitor_id").alias("count"), F.min(v).alias("min_booking_value"), F.max(v).alias("max_booking_value"),
            (F.sum(v) / F.count("visitor_id")).alias("mean_booking_value"), F.sum(v).alias("total_booking_value"),
            median_cont("total_net_cruise_revenue", median == "approx").alias("median_booking_value"))
    return out.select("side", "web_request_type", "count", "min_booking_value", "max_booking_value",
                      "mean_booking_value", "total_booking_value", "median_booking_value")


def type_order() -> Column:
    """Report order of the request types: the listed ones first, in their order."""
    t = F.col("web_request_type")
    order = None
    for i, name in enumerate(TYPE_ORDER):
        order = F.when(t == name, F.lit(str(i))) if order is None else order.when(t == name, F.lit(str(i)))
    return order.otherwise(t)


def side_by_side(report: DataFrame, web_request_type: str = "ALL") -> DataFrame:
    """metric x (left, right) table for one request type (unpivot + pivot)."""
    r = report.filter(F.col("web_request_type") == web_request_type)
    long = r.select("side", F.expr(
        "stack(4, 'min', min_booking_value, 'mean', mean_booking_value, "
        "'median', median_booking_value, 'max', max_booking_value) AS (metric, value)"))
    return long.groupBy("metric").pivot("side", ["left", "right"]).agg(F.max("value"))


def visits_rollup(visits: DataFrame) -> DataFrame:
    """Per (visitor, day): visits, non-bounce visits, page views, interactions."""
    return (visits.groupBy("visitor_id", F.to_date("visit_start_timestamp").alias("date"))
            .agg(F.count_distinct("visit_id").alias("visits"),
                 F.count_if(~F.col("is_bounce")).alias("non_bounce_visits"),
                 F.sum("pageview_count").alias("pageviews"),
                 F.sum("content_interaction_count").alias("interactions")))
