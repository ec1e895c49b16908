"""Days between a page visit and the cruise departure date.

Page views carrying a departure-date parameter are parsed with a list of
formats (first that fits), classified into page groups (funnel before
itinerary), and summarised globally, by destination, or as a banded
distribution.  Funnel pages carry no destination, so it is inherited from
the last itinerary page of the same session, else of the same user — two
``max_by`` aggregations (map-side combined) and two left equi-joins with
exactly one row per key on the right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import buckets as B
from wayfare.functions import vocab as V
from wayfare.functions.dates import parse_multi_date, yyyymmdd_to_date
from wayfare.functions.stats import median_disc

U, SID, TS = "user_pseudo_id", "ga_session_id", "event_timestamp"


def classified_views(events: DataFrame, period: tuple[str, str] | None = None,
                     formats: list[str] | None = None, vocab: V.Vocab = V.DEFAULT_VOCAB) -> DataFrame:
    ev = events.filter((F.col("event_name") == V.PAGE_VIEW) & F.col("p_departure_date").isNotNull())
    if period is not None:
        ev = ev.filter(F.col("event_date").between(*period))
    return ev.select(
        U, SID, TS, "event_id",
        yyyymmdd_to_date(F.col("event_date")).alias("visit_date"),
        parse_multi_date(F.col("p_departure_date"), formats or V.DEPARTURE_FORMATS).alias("departure_date"),
        V.page_group(F.col("page_location"), vocab).alias("page_group"),
        "p_sub_category",
    )


def _days(c: DataFrame) -> DataFrame:
    return c.withColumn("days_before", F.datediff("departure_date", "visit_date"))


def _median_disc_double(col: str, approx: bool = False) -> Column:
    return F.round(median_disc(col, approx).cast("double"), 1)


def with_destination(c: DataFrame) -> DataFrame:
    """Own destination on itinerary pages; funnel pages inherit session, then user."""
    itin = c.filter((F.col("page_group") == "Itinerary Page") & F.col("p_sub_category").isNotNull())
    order = F.struct(F.col(TS), F.col("event_id"))
    last_sess = itin.groupBy(U, SID).agg(F.max_by("p_sub_category", order).alias("sub_category_session"))
    last_user = itin.groupBy(U).agg(F.max_by("p_sub_category", order).alias("sub_category_user"))
    base = c.filter(F.col("page_group").isNotNull() & F.col("departure_date").isNotNull())
    j = base.join(last_sess, [U, SID], "left").join(last_user, U, "left")
    own = F.when(F.col("page_group") == "Itinerary Page", F.col("p_sub_category"))
    return j.withColumn("final_sub_category",
                        F.coalesce(own, F.col("sub_category_session"), F.col("sub_category_user")))


def departure_summary(c: DataFrame, by_destination: bool = False, approx: bool = False) -> DataFrame:
    if by_destination:
        d = _days(with_destination(c)).filter(F.col("final_sub_category").isNotNull())
        keys = ["page_group", "final_sub_category"]
    else:
        d = _days(c.filter(F.col("page_group").isNotNull() & F.col("departure_date").isNotNull()))
        keys = ["page_group"]
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_pageviews"),
        F.round(F.avg("days_before"), 1).alias("avg_days_before_departure"),
        _median_disc_double("days_before", approx).alias("median_days_before_departure"))


def departure_hist(c: DataFrame, by_destination: bool = False, bands=None, else_label=None) -> DataFrame:
    bands = bands or B.DEPARTURE_BANDS
    else_label = else_label or B.DEPARTURE_ELSE
    if by_destination:
        d = _days(with_destination(c)).filter(F.col("final_sub_category").isNotNull())
        keys = ["page_group", "final_sub_category"]
    else:
        d = _days(c).filter(F.col("page_group").isNotNull() & F.col("days_before").isNotNull())
        keys = ["page_group"]
    d = d.withColumn("days_bucket", B.bucketize(F.col("days_before"), bands, else_label))
    return d.groupBy(*keys, "days_bucket").agg(F.count(F.lit(1)).alias("total_pageviews"))


def departure_days(c: DataFrame, by_destination: bool = False) -> DataFrame:
    """The rows that the summaries count: page group (and destination), visit day, days before departure.

    ``operators.sketches`` turns them into daily sketches, from which any period's report is merged."""
    if by_destination:
        return _days(with_destination(c)).filter(F.col("final_sub_category").isNotNull()).select(
            "page_group", "final_sub_category", "visit_date", "days_before")
    return _days(c.filter(F.col("page_group").isNotNull() & F.col("departure_date").isNotNull())).select(
        "page_group", "visit_date", "days_before")
