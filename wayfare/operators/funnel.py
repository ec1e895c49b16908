"""Post-step funnel: one row per user from the first start-step event.

From the user's first start-step page view: the next ``n`` touchpoints of the
same session (page views and labelled actions), pivoted to pv_1..pv_n, and
0/1 flags for actions later in that session.  Users who visited the
personal area earlier in the same session are excluded.

Everything is keyed by user: the first step is a ``min_by`` aggregation
(partial, skew-safe), the same-session join has exactly one start row per
user, and the top-n ranking is a rank filter that Spark executes as
``WindowGroupLimit`` (top-n kept per partition before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import vocab as V

U, SID, TS = "user_pseudo_id", "ga_session_id", "event_timestamp"


def default_touch_label() -> Column:
    e = F.col("event_name")
    return (F.when(e == V.REQUEST_CALL_BACK, F.lit("RAC")).when(e == V.REQUEST_QUOTE, F.lit("RAQ"))
            .when(e == V.REQUEST_BROCHURE, F.lit("Brochure")).when(V.booking_hold(strict=True), F.lit("BH"))
            .otherwise(F.col("page_location")))


def default_touch_filter() -> Column:
    e = F.col("event_name")
    return ((e == V.PAGE_VIEW) | (e == V.REQUEST_CALL_BACK) | (e == V.REQUEST_QUOTE)
            | (e == V.REQUEST_BROCHURE) | V.booking_hold(strict=True))


def default_flags() -> dict[str, Column]:
    e = F.col("event_name")
    return {
        "flag_rac": e == V.REQUEST_CALL_BACK,
        "flag_raq": e == V.REQUEST_QUOTE,
        "flag_brochure": e == V.REQUEST_BROCHURE,
        "flag_bh": V.booking_hold(strict=True),
        "flag_purchase": V.purchase("B"),
        "flag_reingresso_viaggio_diverso": (e == V.BEGIN_CHECKOUT) & F.col("p_journey_code").isNotNull()
        & (F.col("p_journey_code") != F.col("ss_journey_code")),
    }


def funnel_rows(events: DataFrame, period: tuple[str, str] | None = None, vocab: V.Vocab = V.DEFAULT_VOCAB,
                start: Column | None = None, exclude_before: Column | None = None, touch_filter: Column | None = None,
                touch_label: Column | None = None, flags: dict[str, Column] | None = None) -> DataFrame:
    """The rows that the funnel counts: every user's first step with each event of its session.

    One same-session join serves the exclusion (before the step) and the touchpoints and flags (after it); a
    step without a session stands alone.  Conditions become columns here, so what is read again is narrow."""
    base = events if period is None else events.filter(F.col("event_date").between(*period))
    if start is None:
        start = (F.col("event_name") == V.PAGE_VIEW) & F.col("page_location").like(f"%{vocab.suite_step_fragment}%")
    if exclude_before is None:
        exclude_before = F.lower(F.col("page_location")).like(vocab.personal_area_like)
    touch_filter = default_touch_filter() if touch_filter is None else touch_filter
    touch_label = default_touch_label() if touch_label is None else touch_label
    flags = default_flags() if flags is None else flags

    first = (base.filter(start)
             .groupBy(U)
             .agg(F.min_by(F.struct(F.col(SID).alias("ss_session"), F.col(TS).alias("ss_ts"),
                                    F.col("event_ts").alias("ss_event_ts"),
                                    F.col("page_location").alias("ss_page_url"),
                                    F.col("p_journey_code").alias("ss_journey_code")),
                           F.struct(F.col(TS), F.col("event_id"))).alias("fs"))
             .select(F.col(U).alias("_user"), "fs.*"))
    same = first.join(base, (F.col("_user") == F.col(U)) & (F.col(SID) == F.col("ss_session")), "left")
    after = F.coalesce(F.col(TS) > F.col("ss_ts"), F.lit(False))

    def holds(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))
    return same.select(
        F.col("_user").alias(U), "ss_journey_code", "ss_event_ts", "ss_page_url", F.col(TS).alias("at"), "event_id",
        holds((F.col(TS) < F.col("ss_ts")) & exclude_before).cast("int").alias("_excluded"),
        F.when(after & touch_filter, touch_label).alias("_touch"), holds(after & touch_filter).alias("_touches"),
        *[holds(after & c).cast("int").alias(name) for name, c in flags.items()])


def suite_funnel(events: DataFrame, n: int = 10, period: tuple[str, str] | None = None,
                 vocab: V.Vocab = V.DEFAULT_VOCAB, start: Column | None = None,
                 exclude_before: Column | None = None, touch_filter: Column | None = None,
                 touch_label: Column | None = None, flags: dict[str, Column] | None = None,
                 rows: DataFrame | None = None) -> DataFrame:
    """One row a user; ``rows`` are the ``funnel_rows`` of these events where the caller has written them
    (both branches below then read them instead of joining the events again)."""
    flags = default_flags() if flags is None else flags
    if rows is None:
        rows = funnel_rows(events, period, vocab, start, exclude_before, touch_filter, touch_label, flags)
    # what a user's step says is the key, the rest are numbers: a hash aggregation
    users = (rows.groupBy(U, "ss_journey_code", "ss_event_ts", "ss_page_url")
             .agg(F.max("_excluded").alias("_excluded"), *[F.max(name).alias(name) for name in flags])
             .filter("_excluded = 0"))
    w = Window.partitionBy(U).orderBy("at", "event_id")
    touches = (rows.filter("_touches").select(U, "at", "event_id", "_touch")
               .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)          # WindowGroupLimit
               .groupBy(U).agg(F.map_from_entries(F.collect_list(F.struct("rank", "_touch"))).alias("_pv")))
    return users.join(touches, U, "left").select(
        U, "ss_journey_code", F.col("ss_event_ts").alias("suite_selection_timestamp"),
        F.col("ss_page_url").alias("pv_0"), *[F.try_element_at("_pv", F.lit(i)).alias(f"pv_{i}") for i in range(1, n + 1)],
        *flags)
