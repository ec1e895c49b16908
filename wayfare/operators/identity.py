"""Identity linking from web cookies to CRM individuals and bookings.

Chain: cookie id -> identity cluster (``google_ids`` array) -> latest
individual id -> booking role -> booking header (status 'BK').

* Array membership (``cookie IN UNNEST(google_ids)``) is planned by Spark
  as a nested-loop join when written with ``array_contains``; we explode the
  array once and equi-join instead (hash-partitioned on the cookie id).
* "First booking after the lead" is an as-of lookup.  Booking dates are days,
  so an individual's distinct ones form a short list (at most one entry a
  day of history); leads join that one row and read the earliest later date
  off it.  No (lead, booking) pair is made, and both inputs are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import vocab as V
from wayfare.functions.text import regex_extract_or_null

U = "user_pseudo_id"


def cookie_to_cluster(super_ids: DataFrame) -> DataFrame:
    """(google_id, super_id) — one row per array element; empty/NULL arrays vanish."""
    return super_ids.select("super_id", F.explode("google_ids").alias("google_id"))


def link_individuals(df: DataFrame, super_ids: DataFrame, latest: DataFrame, how: str = "inner") -> DataFrame:
    """Attach super_id and IndividualId (string) to rows keyed by user_pseudo_id.

    A cookie in several clusters fans out to several rows (as the warehouse
    join does)."""
    c2c = cookie_to_cluster(super_ids)
    j = df.join(c2c, df[U] == c2c["google_id"], how).drop("google_id")
    j = j.join(latest, "super_id", how)
    return j.withColumn("IndividualId", F.col("latest_individual_id").cast("string"))


def confirmed_bookings(role: DataFrame, header: DataFrame, status: str = "BK") -> DataFrame:
    """(IndividualId string, confirmation_date DATE) of bookings in ``status``."""
    h = header.filter(F.col("BkgStatus") == status)
    return role.join(h, "BkgCod").select(F.col("IndividualId").cast("string").alias("IndividualId"),
                                         F.to_date("ConfirmationDate").alias("confirmation_date"))


def first_booking_after(leads: DataFrame, bookings: DataFrame, lead_date: str,
                        key: str = "IndividualId", out: str = "first_booking_after") -> DataFrame:
    """For each lead row, the earliest booking date of the same individual strictly
    after ``lead_date`` (NULL when none or when the lead has no individual).

    Leads without an individual get a per-row surrogate key that no booking
    carries: they are spread over many keys instead of forming one NULL group."""
    dates = (bookings.filter(F.col(key).isNotNull() & F.col("confirmation_date").isNotNull())
             .groupBy(F.col(key).cast("string").alias("_k"))
             .agg(F.collect_set("confirmation_date").alias("_dates")))
    unlinked = F.concat(F.lit("\u0001unlinked-"), F.xxhash64(*[F.col(c) for c in leads.columns]).cast("string"))
    return (leads.withColumn("_k", F.coalesce(F.col(key).cast("string"), unlinked)).join(dates, "_k", "left")
            .withColumn(out, F.array_min(F.filter("_dates", lambda d: d > F.to_date(F.col(lead_date))))).drop("_k", "_dates"))


def webq_events(events: DataFrame, period=None, steps=None) -> DataFrame:
    ev = events if period is None else events.filter(F.col("event_date").between(*period))
    return (ev.filter((F.col("event_name") == V.LEAD_WEBQ) & F.col(U).isNotNull()
                      & F.col("voyage_funnel_step_name").isin(steps or V.WEBQ_STEPS))
            .select(U, "event_timestamp", F.to_date("event_date", "yyyyMMdd").alias("webq_date"),
                    F.col("voyage_funnel_step_name").alias("funnel_step")))


def step_visitors(events: DataFrame, period=None) -> DataFrame:
    ev = events if period is None else events.filter(F.col("event_date").between(*period))
    step = F.col("voyage_funnel_step_name")
    label = None
    for s in V.FUNNEL_STEPS:
        label = F.when(step == s, F.lit(f"{s} WEBQ")) if label is None else label.when(step == s, F.lit(f"{s} WEBQ"))
    return (ev.filter((F.col("event_name") == V.PAGE_VIEW) & step.isin(V.FUNNEL_STEPS) & F.col(U).isNotNull())
            .groupBy(label.alias("funnel_step")).agg(F.count_distinct(U).alias("visitors")))


def lead_funnel_by_step(events: DataFrame, super_ids: DataFrame, latest: DataFrame,
                        role: DataFrame, header: DataFrame, period=None) -> DataFrame:
    w = link_individuals(webq_events(events, period), super_ids, latest, "inner")
    leads = w.select("funnel_step", U, "webq_date", "IndividualId").distinct()
    conv = first_booking_after(leads, confirmed_bookings(role, header), "webq_date")
    per = conv.groupBy("funnel_step", U, "webq_date").agg(
        F.min("first_booking_after").alias("first_booking_after_webq"))
    agg = per.groupBy("funnel_step").agg(
        F.count(F.lit(1)).alias("webq_count"), F.count_distinct(U).alias("webq_users"),
        F.count_if(F.col("first_booking_after_webq").isNotNull()).alias("converted_webq"),
        F.round(F.avg(F.datediff("first_booking_after_webq", "webq_date")), 1).alias("avg_days_to_booking"))
    return (agg.join(step_visitors(events, period), "funnel_step", "left")
            .select("funnel_step", "visitors", "webq_users", "webq_count", "converted_webq",
                    F.round(F.try_divide(F.col("converted_webq"), F.col("webq_users")) * 100, 2)
                    .alias("webq_to_booking_pct"), "avg_days_to_booking"))


def step_order() -> Column:
    """Place of a WEBQ step in the funnel."""
    step = F.col("funnel_step")
    return (F.when(step == V.WEBQ_STEPS[0], 1).when(step == V.WEBQ_STEPS[1], 2).when(step == V.WEBQ_STEPS[2], 3))


def lead_step_labels(events: DataFrame, period=None) -> DataFrame:
    """Diagnostic: actual step labels on WEBQ events and their counts."""
    ev = events if period is None else events.filter(F.col("event_date").between(*period))
    return (ev.filter(F.col("event_name") == V.LEAD_WEBQ)
            .groupBy(F.col("voyage_funnel_step_name").alias("funnel_step"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def identity_coverage(events: DataFrame, super_ids: DataFrame, latest: DataFrame, period=None) -> DataFrame:
    """WEBQ users, how many reach a cluster and an individual (counts after fan-out)."""
    ev = events if period is None else events.filter(F.col("event_date").between(*period))
    users = ev.filter((F.col("event_name") == V.LEAD_WEBQ) & F.col(U).isNotNull()).select(U).distinct()
    c2c = cookie_to_cluster(super_ids)
    j = users.join(c2c, users[U] == c2c["google_id"], "left").join(latest, "super_id", "left")
    return j.agg(F.count(F.lit(1)).alias("webq_users_tot"),
                 F.count_if(F.col("super_id").isNotNull()).alias("con_super_id"),
                 F.count_if(F.col("latest_individual_id").isNotNull()).alias("con_individual_id"))


def key_match(events: DataFrame, web_requests: DataFrame, period=None) -> DataFrame:
    """Distinct web-side request ids and how many of them match a CRM request id."""
    ev = events if period is None else events.filter(F.col("event_date").between(*period))
    g = ev.filter((F.col("event_name") == V.LEAD_WEBQ) & F.col("uwrid").isNotNull()).select("uwrid").distinct()
    total = g.agg(F.count(F.lit(1)).alias("uwrid_ga4_distinti"))
    matched = g.join(web_requests.select("uwrid"), "uwrid").agg(F.count(F.lit(1)).alias("uwrid_in_match"))
    return total.crossJoin(matched)   # two single-row aggregates


def id_from_url(events: DataFrame, period=None, pattern: str = V.INDIVIDUAL_ID_REGEX) -> DataFrame:
    ev = events if period is None else events.filter(F.col("event_date").between(*period))
    return (ev.filter(F.col("raw_url").like("%IndividualId=%"))
            .groupBy(regex_extract_or_null(F.col("raw_url"), pattern).alias("IndividualId"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def source_date_ranges(events: DataFrame, web_requests: DataFrame, header: DataFrame, period=None) -> DataFrame:
    ev = events if period is None else events.filter(F.col("event_date").between(*period))
    d = F.to_date("event_date", "yyyyMMdd")
    a = ev.filter(F.col("event_name") == V.LEAD_WEBQ).agg(F.lit("GA4 WEBQ").alias("fonte"),
                                                          F.min(d).alias("dal"), F.max(d).alias("al"))
    b = web_requests.agg(F.lit("CRM WebRequest").alias("fonte"), F.min(F.to_date("Date")).alias("dal"),
                         F.max(F.to_date("Date")).alias("al"))
    c = header.filter(F.col("BkgStatus") == "BK").agg(
        F.lit("CRM BkgHdr (BK)").alias("fonte"), F.min(F.to_date("ConfirmationDate")).alias("dal"),
        F.max(F.to_date("ConfirmationDate")).alias("al"))
    return a.unionByName(b).unionByName(c)
