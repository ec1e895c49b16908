"""Page paths: backward session pivot before conversions, and session journeys.

``page_path_backward`` numbers the sessions preceding each conversion
backwards (-1 = most recent) inside the reset window, adds the conversion
session as position 0 (truncated before the action) and counts, per URL,
in how many (conversion, position) session instances it appeared.

Instead of ranking every (conversion, earlier session) pair, each
conversion derives its candidate session indexes arithmetically from two
running counts — sessions started before the action (``n_lt``) and
sessions started at or before the previous action (``n_prev``) — and
explodes at most ``depth + 1`` of them.  The fan-out is bounded by the
depth, never by the user's history.  Page views are reduced to the first view
of a URL in a session, and conversions to counts, before the two are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import vocab as V
from wayfare.operators import sessions as S
from wayfare.operators.ordered import running_aggregate

U, SID, TS = "user_pseudo_id", "ga_session_id", "event_timestamp"


def page_path_points(events: DataFrame, action_rule: Column | None = None, since: str | None = None,
                     page_period: tuple[str, str] | None = None) -> DataFrame:
    """The stream that ``page_path_backward`` reads: session starts, conversions with their session, first page views."""
    if action_rule is None:
        action_rule = V.booking_hold(False) | V.purchase("A")
    return S.tagged_points(events, {"conversion": action_rule}, None, since, keep_session=True, page_period=page_period, pages=True)


def page_path_backward(events: DataFrame, action_rule: Column | None = None, depth: int = 10,
                       since: str | None = None, page_period: tuple[str, str] | None = None,
                       pivot_columns: int | None = None, points: DataFrame | None = None) -> DataFrame:
    """``events`` feeds the sessions (whole history); conversions and page views are bounded by ``since`` and
    ``page_period``.  ``points`` is the stream of these events where the caller has written it (the branches
    below then read sessions, conversions and pages instead of the events)."""
    if points is None:
        points = page_path_points(events, action_rule, since, page_period)
    # conversions of one instant are one occurrence; its lowest session id is the
    # one skipped among the earlier sessions, all of them stand at position 0
    actions = S.conversions_of(points).groupBy(U, "action_ts").agg(
        F.min("conversion_session_id").alias("conversion_session_id"),
        F.sort_array(F.collect_set("conversion_session_id")).alias("own_sessions"))
    acts, idx = S._counted_points(actions, S.starts_of(points), [U])     # n_lt, n_prev per action; session index

    # candidate session indexes: most recent first, one extra in case the
    # conversion session itself is among them and has to be skipped
    cand = (acts.filter(F.col("n_lt") > F.col("n_prev"))
            .select(U, "action_ts", "conversion_session_id",
                    F.explode(F.sequence(F.col("n_lt"),
                                         F.greatest(F.col("n_prev") + 1, F.col("n_lt") - depth),
                                         F.lit(-1).cast("long"))).alias("session_idx")))
    idx = idx.select(U, "session_idx", "session_id")
    prev = (cand.join(idx, [U, "session_idx"])
            .filter(F.col("session_id") != F.col("conversion_session_id")))
    w = Window.partitionBy(U, "action_ts").orderBy(F.col("session_idx").desc())
    # conversions that share (session, position) are counted before they meet the pages
    before = (prev.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= depth)
              .groupBy(U, "session_id", (-F.col("_rn")).alias("session_position"))
              .agg(F.count(F.lit(1)).alias("n")))

    pages = S.pages_of(points)
    counted = (before.join(pages, [U, "session_id"]).select("session_position", "page_url", "n")
               .unionByName(_own_session_pages(actions, pages)))
    width = max(depth, pivot_columns or depth)      # e.g. depth 7 in a 0..10 report layout
    aggs = [F.sum(F.when(F.col("session_position") == -i, F.col("n")).otherwise(0)).alias(f"session_minus_{i}")
            for i in range(width + 1)]
    return counted.groupBy("page_url").agg(*aggs, F.sum("n").alias("total_appearances"))


def _own_session_pages(actions: DataFrame, pages: DataFrame) -> DataFrame:
    """Position 0: per URL the conversions of the own session(s) later than its first view.

    A URL was seen before a conversion iff its first view was, so a session's
    URLs and conversions are merged into one stream by time and the conversions
    up to each first view are subtracted from all: linear in rows, no
    (conversion, page) pair.
    """
    own = actions.filter(F.size("own_sessions") > 0).select(
        U, F.concat_ws(",", F.col("own_sessions").cast("array<string>")).alias("unit"), "own_sessions", "action_ts")
    sessions_of = own.select(U, "unit", "own_sessions").distinct().select(
        U, "unit", F.explode("own_sessions").alias("session_id"))
    seen = sessions_of.join(pages, [U, "session_id"]).groupBy(U, "unit", "page_url").agg(F.min("first_view").alias("_t"))
    stream = (seen.withColumn("_n", F.lit(0))
              .unionByName(own.select(U, "unit", F.lit(None).cast("string").alias("page_url"),
                                      F.col("action_ts").alias("_t"), F.lit(1).alias("_n"))))
    stream = running_aggregate(stream, [U, "unit"], "_t", "_n", "_upto", agg="sum", frame="le")
    totals = own.groupBy(U, "unit").agg(F.count(F.lit(1)).alias("_all"))
    return (stream.filter(F.col("page_url").isNotNull()).join(totals, [U, "unit"])
            .select(F.lit(0).alias("session_position"), "page_url", (F.col("_all") - F.col("_upto")).alias("n"))
            .filter("n > 0"))


JOURNEY_BUCKET_MICROS = 5 * 60_000_000

LEAD_FLAGS = {  # output column -> event name (fixed values)
    "has_WBBK": "generate_lead_WBBK", "has_WBOF_01": "generate_lead_WBOF_01",
    "has_WBOF_02": "generate_lead_WBOF_02", "has_WBOF_03": "generate_lead_WBOF_03",
    "has_WBOF_04": "generate_lead_WBOF_04", "has_WEBQ": "generate_lead_WEBQ",
    "has_RAB": "generate_lead_RAB", "has_RAQ": "generate_lead_RAQ", "has_SFO": "generate_lead_SFO",
}


def journey_pages(events: DataFrame, n: int = 10, vocab: V.Vocab = V.DEFAULT_VOCAB,
                  period: tuple[str, str] | None = None) -> DataFrame:
    """One row per session: page_1..page_n with consecutive repeats (refreshes)
    collapsed, plus session flags (funnel entry = a quote-host URL, lead types)."""
    ev = events.filter(F.col(SID).isNotNull())
    if period is not None:
        ev = ev.filter(F.col("event_date").between(*period))
    keys = [U, SID]
    pv = ev.filter((F.col("event_name") == V.PAGE_VIEW) & F.col("page_location").isNotNull()) \
        .select(*keys, TS, "event_id", "page_location")
    # previous page of the session = max (ts, event_id, url) over earlier rows, from the
    # prefix scan in buckets of a few minutes: a long session is split, a short one is not
    prev = F.struct(F.col(TS), F.col("event_id"), F.col("page_location").alias("url"))
    pv = running_aggregate(pv, keys, TS, prev, "_prev", agg="max", frame="rows_lt", tiebreak=["event_id"],
                           bucket_micros=JOURNEY_BUCKET_MICROS)
    w = Window.partitionBy(*keys).orderBy(TS, "event_id")
    pv = (pv.filter(F.col("_prev").isNull() | (F.col("_prev.url") != F.col("page_location")))
          .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n))   # WindowGroupLimit
    pages = pv.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_rn") == i, F.col("page_location"))).alias(f"page_{i}") for i in range(1, n + 1)])
    flag_aggs = [F.max(F.when(F.col("page_location").contains(vocab.quote_host), 1).otherwise(0)).alias("has_FE")]
    flag_aggs += [F.max(F.when(F.col("event_name") == e, 1).otherwise(0)).alias(c) for c, e in LEAD_FLAGS.items()]
    flags = ev.groupBy(*keys).agg(*flag_aggs)
    return flags.join(pages, keys, "left").select(
        *keys, *[f"page_{i}" for i in range(1, n + 1)], "has_FE", *LEAD_FLAGS)
