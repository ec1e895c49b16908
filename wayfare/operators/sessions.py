"""Sessions, conversions and session-reset counting (sessions/days before conversion).

Reset logic: for a conversion at ``t`` whose previous conversion of the same
type (same user) was at ``p``, the window is ``(p, t]``; with no previous
conversion it is ``(-inf, t]``.

Joining every conversion with every session of the user and filtering on the
range would be a per-user cross product.  Here the same numbers
come from running counts: with ``N(x)`` = number of the user's sessions that
started at or before ``x``, the count of sessions in ``(p, t]`` is
``N(t) - N(p)`` and the first session in the window is the session with
index ``N(p) + 1``.  Both are computed by ``running_aggregate`` (bucketed,
skew-safe) and one equi-join on (user, session index).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import buckets as B
from wayfare.functions import vocab as V
from wayfare.functions.dates import elapsed_days
from wayfare.functions.stats import median_disc
from wayfare.operators.ordered import running_aggregate

U, SID, TS = "user_pseudo_id", "ga_session_id", "event_timestamp"


def sessions(events: DataFrame) -> DataFrame:
    """(user, session_id, session_start_ts); events without a session id are ignored.

    A partial/final aggregation: a heavy user is combined map-side, so no
    task receives all of a user's events.
    """
    return (events.filter(F.col(SID).isNotNull())
            .groupBy(U, F.col(SID).alias("session_id"))
            .agg(F.min(TS).alias("session_start_ts")))


def default_conversion_rules() -> dict[str, Column]:
    return {V.HOLD: V.booking_hold(strict=False), V.PURCHASE_LABEL: V.purchase("A")}


def conversions(events: DataFrame, rules: dict[str, Column] | None = None,
                total_label: str | None = V.ANY_LABEL, since: str | None = None,
                keep_session: bool = False) -> DataFrame:
    """Classify conversion events (first matching rule wins) into
    (user, action_ts, action_type[, conversion_session_id]).

    ``total_label`` replicates every conversion under one extra type (the
    "Any (OR)" group) so that reset logic also runs on the merged series.
    ``since`` bounds the action period (yyyyMMdd, inclusive lower bound).
    """
    rules = rules or default_conversion_rules()
    label = None
    for name, cond in rules.items():
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    ev = events
    if since is not None:
        ev = ev.filter(F.col("event_date") >= F.lit(since))
    cols = [F.col(U), F.col(TS).alias("action_ts")]
    if keep_session:
        cols.append(F.col(SID).alias("conversion_session_id"))
    acts = ev.select(*cols, label.alias("action_type")).filter(F.col("action_type").isNotNull())
    if total_label:
        # replicate each conversion under the merged label in the same scan
        acts = acts.withColumn("action_type", F.explode(F.array(F.col("action_type"), F.lit(total_label))))
    return acts


def tagged_points(events: DataFrame, rules: dict[str, Column] | None = None, total_label: str | None = V.ANY_LABEL,
                  since: str | None = None, keep_session: bool = False,
                  page_period: tuple[str, str] | None = None, pages: bool = False) -> DataFrame:
    """Everything a journey analysis takes from the events, as one tagged stream: one scan, one exchange.

    ``start``       first event of a session                            (session_id, at)
    ``conversion``  one occurrence per instant and type, and own session
                    where ``keep_session``                              (label, session_id, at)
    ``page``        first view of a URL in a session, where ``pages``   (session_id, label, at)

    An event feeds up to four of them and all are combined map-side, so what is
    shuffled is sessions, conversions and pages, not events.  Rows without a user
    belong to no journey.  Callers read several branches of the stream: write it
    once (``session.checkpointed``) rather than scan the events for each."""
    label = None
    for name, cond in (rules or default_conversion_rules()).items():
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    if since is not None:
        label = F.when(F.col("event_date") >= F.lit(since), label)
    sid, ts, nothing = F.col(SID), F.col(TS), F.lit(None)

    def point(when: Column, tag: str, session: Column, text: Column, at: Column) -> Column:
        return F.when(when, F.struct(F.lit(tag).alias("tag"), session.cast("long").alias("session_id"),
                                     text.cast("string").alias("label"), at.cast("long").alias("instant")))
    own = sid if keep_session else nothing
    found = [point(sid.isNotNull(), "start", sid, nothing, nothing),
             point(F.col("_label").isNotNull(), "conversion", own, F.col("_label"), ts)]
    if total_label:
        found.append(point(F.col("_label").isNotNull(), "conversion", own, F.lit(total_label), ts))
    if pages:
        seen = (F.col("event_name") == V.PAGE_VIEW) & F.col("page_location").isNotNull() & sid.isNotNull()
        if page_period is not None:
            seen = seen & F.col("event_date").between(*page_period)
        found.append(point(seen, "page", sid, F.col("page_location"), nothing))
    rows = (events.filter(F.col(U).isNotNull()).withColumn("_label", label)
            .select(U, ts, F.explode(F.filter(F.array(*found), lambda p: p.isNotNull())).alias("p")))
    return (rows.groupBy(U, F.col("p.tag").alias("tag"), F.col("p.session_id").alias("session_id"),
                         F.col("p.label").alias("label"), F.col("p.instant").alias("instant"))
            .agg(F.min(TS).alias("at")).drop("instant"))


def starts_of(points: DataFrame) -> DataFrame:
    return points.filter("tag = 'start'").select(U, "session_id", F.col("at").alias("session_start_ts"))


def conversions_of(points: DataFrame) -> DataFrame:
    return points.filter("tag = 'conversion'").select(U, F.col("at").alias("action_ts"), F.col("label").alias("action_type"),
                                                      F.col("session_id").alias("conversion_session_id"))


def pages_of(points: DataFrame) -> DataFrame:
    return points.filter("tag = 'page'").select(U, "session_id", F.col("label").alias("page_url"), F.col("at").alias("first_view"))


def occurrences(actions: DataFrame) -> DataFrame:
    """One row per (user, type, instant): exports repeat a timestamp within a batch,
    and a repeated conversion must not open a window of its own."""
    return actions.select(U, "action_type", "action_ts").distinct()


def _counted_points(actions: DataFrame, sess: DataFrame, keys: list[str]):
    """One prefix scan over the merged (sessions + actions) stream of each user.

    Returns (actions with n_le / n_lt / n_prev, sessions with session_idx):
    n_le = sessions started at or before the action (N(t)), n_lt = strictly
    before, n_prev = N at the previous action of the same key (0 if none),
    session_idx = 1-based rank of the session in (start, session_id) order.
    """
    pts_s = sess.select(U, F.col("session_start_ts").alias("_t"), F.lit(1).alias("_is_s"),
                        "session_id", "session_start_ts")
    pts_a = actions.select(*actions.columns, F.col("action_ts").alias("_t"), F.lit(0).alias("_is_s"))
    pts = pts_a.unionByName(pts_s, allowMissingColumns=True)
    pts = running_aggregate(pts, [U], "_t", "_is_s", ["n_le", "n_lt", "_n_rows"], agg="sum",
                            frame=["le", "lt", "rows_lt"], tiebreak=["session_id"])
    idx = pts.filter(F.col("_is_s") == 1).select(
        U, (F.col("_n_rows") + 1).alias("session_idx"), "session_id", "session_start_ts")
    acts = pts.filter(F.col("_is_s") == 0).select(*actions.columns, "_t", "n_le", "n_lt")
    # N(p) = N at the previous action of the same key; N is non-decreasing in t,
    # so it is the running max over strictly earlier actions.
    acts = running_aggregate(acts, keys, "_t", "n_le", "n_prev", agg="max", frame="lt")
    acts = acts.withColumn("n_prev", F.coalesce("n_prev", F.lit(0))).drop("_t")
    return acts, idx


def _session_counts(actions: DataFrame, sess: DataFrame, keys: list[str]) -> DataFrame:
    return _counted_points(actions, sess, keys)[0]


def session_index(sess: DataFrame) -> DataFrame:
    """1-based index of each session of a user in (start, session_id) order."""
    idx = running_aggregate(sess.withColumn("_one", F.lit(1)), [U], "session_start_ts", "_one",
                            "session_idx", agg="sum", frame="rows_lt", tiebreak=["session_id"])
    return idx.withColumn("session_idx", F.col("session_idx") + 1).drop("_one")


def sessions_before_conversion(actions: DataFrame, sess: DataFrame) -> DataFrame:
    """Per conversion (user, type, ts): distinct sessions started in (prev, ts].

    Conversions of one type at one instant are one occurrence.  Those with no
    session in their window are dropped (a second conversion in the same
    session).
    """
    acts = _session_counts(occurrences(actions), sess, [U, "action_type"])
    return (acts.select(U, "action_type", "action_ts",
                        (F.col("n_le") - F.col("n_prev")).alias("sessions_before_action"))
            .filter(F.col("sessions_before_action") >= 1))


def _median_disc(col: str, approx: bool = False) -> Column:
    # lower median (an input element, no interpolation); long like the input
    return median_disc(col, approx).cast("long")


def summarize_sessions_before(per_action: DataFrame, approx: bool = False) -> DataFrame:
    return (per_action.groupBy("action_type")
            .agg(F.count(F.lit(1)).alias("occurrences"),
                 F.round(F.avg("sessions_before_action"), 2).alias("avg_sessions_before"),
                 _median_disc("sessions_before_action", approx).alias("median_sessions_before")))


def sessions_before_hist(per_action: DataFrame, bands=None, else_label=None) -> DataFrame:
    bands = bands or B.SESSIONS_BANDS
    else_label = else_label or B.SESSIONS_ELSE
    return (per_action
            .withColumn("sessions_bucket",
                        B.bucketize(F.col("sessions_before_action"), bands, else_label))
            .groupBy("action_type", "sessions_bucket")
            .agg(F.count(F.lit(1)).alias("occurrences"),
                 F.min("sessions_before_action").alias("least_sessions")))


def days_before_conversion(actions: DataFrame, sess: DataFrame) -> DataFrame:
    """Per conversion: whole days from the first session of its reset window
    (conversions of one type at one instant are one occurrence)."""
    acts, idx = _counted_points(occurrences(actions), sess, [U, "action_type"])
    acts = acts.filter(F.col("n_le") > F.col("n_prev")) \
        .withColumn("session_idx", F.col("n_prev") + 1)
    idx = idx.select(U, "session_idx", "session_start_ts")
    j = acts.join(idx, [U, "session_idx"], "inner")
    return j.select(U, "action_type", "action_ts",
                    F.col("session_start_ts").alias("window_start_ts"),
                    elapsed_days("action_ts", "session_start_ts").alias("days"))


def summarize_days_before(with_days: DataFrame, bands=None, else_label=None, approx: bool = False) -> DataFrame:
    """Summary rows and band rows in one long table (row_type)."""
    bands = bands or B.DAYS_BANDS
    else_label = else_label or B.DAYS_ELSE
    summary = (with_days.groupBy("action_type")
               .agg(F.count(F.lit(1)).alias("occurrences"),
                    F.round(F.avg("days"), 2).alias("avg_days"),
                    _median_disc("days", approx).alias("median_days"))
               .select("action_type", F.lit("summary").alias("row_type"),
                       F.lit(None).cast("string").alias("days_bucket"),
                       "occurrences", "avg_days", "median_days"))
    dist = (with_days.withColumn("days_bucket", B.bucketize(F.col("days"), bands, else_label))
            .groupBy("action_type", "days_bucket").agg(F.count(F.lit(1)).alias("occurrences"))
            .select("action_type", F.lit("distribution").alias("row_type"), "days_bucket",
                    "occurrences", F.lit(None).cast("double").alias("avg_days"),
                    F.lit(None).cast("long").alias("median_days")))
    return summary.unionByName(dist)


def first_visit_to_action(events: DataFrame, actions: DataFrame) -> DataFrame:
    """No-reset variant: days from the user's first event to the first action per type."""
    fa = actions.groupBy(U, "action_type").agg(F.min("action_ts").alias("first_action_ts"))
    fv = events.groupBy(U).agg(F.min(TS).alias("first_visit_ts"))
    d = fa.join(fv, U).withColumn("days", elapsed_days("first_action_ts", "first_visit_ts"))
    return (d.groupBy("action_type")
            .agg(F.count(F.lit(1)).alias("users"), F.round(F.avg("days"), 2).alias("avg_days"),
                 _median_disc("days").alias("median_days")))


def with_previous(actions: DataFrame, keys: list[str], ts: str = "action_ts",
                  out: str = "prev_action_ts") -> DataFrame:
    """LAG(ts) per key, computed as the running max over the rows before (skew-safe);
    of rows with equal ts all but one see that ts."""
    return running_aggregate(actions, keys, ts, ts, out, agg="max", frame="rows_lt")
