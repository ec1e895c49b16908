"""Named queries: each callable takes (spark, sf_dir) and returns a lazy DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.operators import audience as AU
from wayfare.operators import departure as DP
from wayfare.operators import experiment as X
from wayfare.operators import funnel as FU
from wayfare.operators import identity as I
from wayfare.operators import segments as SG
from wayfare.operators import paths as PA
from wayfare.operators import propensity as PR
from wayfare.operators import quality as Q
from wayfare.operators import sessions as S
from wayfare.functions import vocab as V
from wayfare.plans import params as P
from wayfare.sources import driver as D
from wayfare.sources import ga4 as G
from wayfare.session import checkpointed, sf_path
from wayfare.sources.files import delete, signature
from wayfare.sources.tables import load_model, read_table, save_model, warehouse_dir, write_table

Query = Callable[[SparkSession, str], DataFrame]


def _present(fn: Query) -> Query:
    """Report presentation: calendar days leave as midnight TIMESTAMP_NTZ so that
    every consumer (pandas, Arrow, other engines) sees one datetime type."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        cols = [F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.DateType)
                else F.col(f.name) for f in df.schema.fields]
        return df.select(*cols)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _events(spark: SparkSession, sf_dir: str, period: tuple[str, str] | None = None,
            since: str | None = None) -> DataFrame:
    return D.read_events(spark, sf_dir, period=period, since=since)


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions of the action period; the bound reaches the Parquet scan."""
    return S.conversions(_events(spark, sf_dir, since=P.ACTION_SINCE), since=P.ACTION_SINCE)


def _journeys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(conversions, sessions): the events are read once and their points written once; the branches read the points."""
    points = checkpointed(S.tagged_points(_events(spark, sf_dir), since=P.ACTION_SINCE))
    return S.conversions_of(points).drop("conversion_session_id"), S.starts_of(points)


# -- P1 / P1b / P2 / P2b -----------------------------------------------------

def sessions_before_conversion(spark, sf_dir):
    per = S.sessions_before_conversion(*_journeys(spark, sf_dir))
    return S.summarize_sessions_before(per).orderBy("action_type")


def sessions_before_hist(spark, sf_dir):
    hist = S.sessions_before_hist(S.sessions_before_conversion(*_journeys(spark, sf_dir)))
    return hist.orderBy("action_type", "least_sessions").drop("least_sessions")


def days_before_conversion(spark, sf_dir):
    return S.summarize_days_before(S.days_before_conversion(*_journeys(spark, sf_dir))).orderBy("action_type", "row_type", "days_bucket")


def first_visit_to_action(spark, sf_dir):
    return S.first_visit_to_action(_events(spark, sf_dir), _actions(spark, sf_dir)).orderBy("action_type")


# -- P3 / P4 / P17 -----------------------------------------------------------

def _page_path(spark, sf_dir, rule, depth):
    """One run of the path analysis; the report is ``P.PAGE_PATH_DEPTH`` columns wide either way."""
    events = _events(spark, sf_dir)
    points = checkpointed(PA.page_path_points(events, rule, P.ACTION_SINCE, P.PERIOD))
    report = PA.page_path_backward(events, depth=depth, pivot_columns=P.PAGE_PATH_DEPTH, points=points)
    return report.orderBy(F.col("total_appearances").desc(), "page_url")


def page_path_backward_hold(spark, sf_dir):
    """One run per conversion type, as the analysis is meant to be used (depth 7 for Booking Hold, 10 for Purchase)."""
    return _page_path(spark, sf_dir, V.booking_hold(False), P.PAGE_PATH_DEPTH_HOLD)


def page_path_backward_purchase(spark, sf_dir):
    return _page_path(spark, sf_dir, V.purchase("A"), P.PAGE_PATH_DEPTH)


def page_path_backward(spark, sf_dir):
    return _page_path(spark, sf_dir, None, P.PAGE_PATH_DEPTH)


def suite_funnel(spark, sf_dir):
    events = _events(spark, sf_dir, P.PERIOD)
    rows = checkpointed(FU.funnel_rows(events, P.PERIOD))
    funnel = FU.suite_funnel(events, n=P.FUNNEL_TOUCHPOINTS, rows=rows)
    return funnel.orderBy("suite_selection_timestamp", "user_pseudo_id")


def journey_pages(spark, sf_dir):
    return PA.journey_pages(_events(spark, sf_dir, P.PERIOD), n=10, period=P.PERIOD)


# -- P5-P8 --------------------------------------------------------------------

def _views(spark, sf_dir):
    return DP.classified_views(_events(spark, sf_dir, P.PERIOD), period=P.PERIOD)


def departure_global(spark, sf_dir):
    return DP.departure_summary(_views(spark, sf_dir)).orderBy("page_group")


def departure_by_dest(spark, sf_dir):
    return DP.departure_summary(_views(spark, sf_dir), by_destination=True).orderBy(
        "page_group", F.col("total_pageviews").desc(), "final_sub_category")


def departure_hist(spark, sf_dir):
    return DP.departure_hist(_views(spark, sf_dir)).orderBy("page_group", "days_bucket")


def departure_hist_by_dest(spark, sf_dir):
    return DP.departure_hist(_views(spark, sf_dir), by_destination=True).orderBy("page_group", "final_sub_category", "days_bucket")


# -- P9 / P9b / P10 / P28 -----------------------------------------------------

def ab_report(spark, sf_dir):
    return X.experiment_report(_events(spark, sf_dir, P.PERIOD), P.EXPERIMENT_ID, period=P.PERIOD).orderBy("variation_id")


def ab_sample(spark, sf_dir):
    expo = X.exposures(_events(spark, sf_dir, P.PERIOD), P.EXPERIMENT_ID, P.PERIOD)
    return X.deterministic_sample(X.clean_assignments(expo), P.SAMPLE_PER_VARIANT)


def ab_clean_users(spark, sf_dir):
    exposed = X.exposures(_events(spark, sf_dir, P.PERIOD), P.EXPERIMENT_ID, P.PERIOD)
    return X.clean_users_per_variant(exposed).orderBy("variation_id")


def component_variant(spark, sf_dir):
    return X.component_variant(_events(spark, sf_dir, P.PERIOD), "payment-loading-progress", "b", period=P.PERIOD)


# -- P11-P16 ------------------------------------------------------------------

def lead_funnel_by_step(spark, sf_dir):
    return I.lead_funnel_by_step(_events(spark, sf_dir, P.PERIOD), D.super_ids(spark, sf_dir),
                                 D.latest_individual(spark, sf_dir), D.booking_role(spark, sf_dir),
                                 D.booking_header(spark, sf_dir), period=P.PERIOD).orderBy(I.step_order())


def lead_step_labels(spark, sf_dir):
    return I.lead_step_labels(_events(spark, sf_dir, P.PERIOD), period=P.PERIOD).orderBy(F.col("cnt").desc(), "funnel_step")


def identity_coverage(spark, sf_dir):
    return I.identity_coverage(_events(spark, sf_dir, P.PERIOD), D.super_ids(spark, sf_dir),
                               D.latest_individual(spark, sf_dir), period=P.PERIOD)


def key_match(spark, sf_dir):
    return I.key_match(_events(spark, sf_dir, P.PERIOD), D.web_request(spark, sf_dir), period=P.PERIOD)


def id_from_url(spark, sf_dir):
    return I.id_from_url(_events(spark, sf_dir, P.PERIOD), period=P.PERIOD).orderBy(F.col("cnt").desc(), "IndividualId")


def source_date_ranges(spark, sf_dir):
    return I.source_date_ranges(_events(spark, sf_dir, P.PERIOD), D.web_request(spark, sf_dir),
                                D.booking_header(spark, sf_dir), period=P.PERIOD)


def prospect_segments(spark, sf_dir):
    bookings = I.confirmed_bookings(D.booking_role(spark, sf_dir), D.booking_header(spark, sf_dir))
    return SG.prospect_segments(_events(spark, sf_dir, P.PERIOD), bookings, period=P.PERIOD)


# -- P18 / P18b / P19 ---------------------------------------------------------

def _audience_report(spark, sf_dir, only=None):
    ev = _events(spark, sf_dir)                              # leads: no period in the report
    seg = D.visitor_segments(_events(spark, sf_dir, P.PERIOD))  # audiences: bounded period
    common = F.col("market").isNotNull() & F.col("date").between(
        F.to_date(F.lit(P.PERIOD[0]), "yyyyMMdd"), F.to_date(F.lit(P.PERIOD[1]), "yyyyMMdd"))
    return AU.compare_audiences(seg, D.visit_leads(ev), left=F.col("segment") == "seg_A",
                                right=F.col("segment") == "seg_B", common=common, only=only)


def audience_compare(spark, sf_dir):
    return _audience_report(spark, sf_dir).orderBy(AU.type_order(), "side")


def audience_side_by_side(spark, sf_dir):
    return AU.side_by_side(_audience_report(spark, sf_dir, only="ALL"), "ALL").orderBy(F.col("metric").desc())


def visits_rollup(spark, sf_dir):
    return AU.visits_rollup(D.curated_visits(_events(spark, sf_dir)))


# -- P20-P27 ------------------------------------------------------------------

def _features(spark, sf_dir, anchors):
    a0, a1, step = anchors
    period = PR.feature_period(a0, a1, P.LOOKBACK_DAYS, P.HORIZON_DAYS)
    return PR.build_features(_events(spark, sf_dir, period), a0, a1, step, P.LOOKBACK_DAYS, P.HORIZON_DAYS)


def propensity_features(spark, sf_dir):
    return _features(spark, sf_dir, P.TRAIN_ANCHORS).orderBy("user_pseudo_id", "anchor_date")


def propensity_scoring(spark, sf_dir):
    return _features(spark, sf_dir, P.SCORE_ANCHORS).orderBy("user_pseudo_id", "anchor_date")


def propensity_split(spark, sf_dir):
    return PR.split_by_user(_features(spark, sf_dir, P.TRAIN_ANCHORS), P.TEST_SHARE, P.SPLIT_SEED)


def propensity_lift(spark, sf_dir):
    test = propensity_split(spark, sf_dir).filter("dataset_split")
    return PR.lift_by_band(PR.rule_score(test)).orderBy("propensity_band")


def propensity_segments(spark, sf_dir):
    return PR.segment_crosstab(PR.rule_score(_features(spark, sf_dir, P.SCORE_ANCHORS))).orderBy(F.col("cnt").desc())


_TRAINED: dict[tuple[str, str], tuple[str, str]] = {}


def _trained(spark, sf_dir):
    """(model, split, scored) of the scoring period: trained and scored once an application for the events as
    they are, then read back from the shared folder by whichever query asks.  Other files at that path mean
    another training; what was written for the earlier ones is deleted.  An input too small for early stopping
    raises (``fit_propensity``)."""
    key, state = (spark.sparkContext.applicationId, sf_dir), signature(spark, sf_path(sf_dir, "events"))
    known, out = _TRAINED.get(key, (None, None))
    if known != state:
        if out:
            delete(spark, out)
        out = warehouse_dir(spark, f"propensity-{uuid.uuid4().hex}")
        split = write_table(propensity_split(spark, sf_dir), f"{out}/split")
        model = PR.fit_propensity(split.filter(~F.col("dataset_split")), seed=P.SPLIT_SEED)
        save_model(model, f"{out}/model", spark)
        write_table(PR.score(model, _features(spark, sf_dir, P.SCORE_ANCHORS)), f"{out}/scored")
        _TRAINED[key] = state, out
    return load_model(f"{out}/model", spark), read_table(spark, f"{out}/split"), read_table(spark, f"{out}/scored")


def propensity_train_predict(spark, sf_dir):
    """Train on the training users, score the scoring-period table."""
    _, _, scored = _trained(spark, sf_dir)
    return scored.select("anchor_date", "user_pseudo_id", "target_conversion", "propensity_score")


def propensity_evaluate(spark, sf_dir):
    """Held-out (test users) and out-of-time (scoring period) metrics."""
    model, split, scored = _trained(spark, sf_dir)
    a = PR.evaluate(PR.score(model, split.filter("dataset_split"))).withColumn("dataset", F.lit("test_split"))
    b = PR.evaluate(scored).withColumn("dataset", F.lit("out_of_time"))
    return a.unionByName(b)


def propensity_importance(spark, sf_dir):
    """Gain share of every feature of the trained model."""
    return PR.feature_importance(_trained(spark, sf_dir)[0], spark).orderBy(F.col("importance").desc(), "feature")


def propensity_score_contract(spark, sf_dir):
    """What predictions promise: a row for each key of the scoring table, its label, a score in [0, 1]."""
    p = F.col("propensity_score")
    return (_trained(spark, sf_dir)[2].groupBy("anchor_date").agg(
        F.count(F.lit(1)).alias("predictions"), F.count_distinct("user_pseudo_id").alias("users"),
        F.sum("target_conversion").cast("long").alias("conversions"),
        F.count_if(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).alias("outside_unit")))


def propensity_rule_metrics(spark, sf_dir):
    """The evaluation metrics over the rule score of the test users and of the scoring period."""
    a = PR.evaluate(PR.rule_score(propensity_split(spark, sf_dir).filter("dataset_split"))).withColumn("dataset", F.lit("test_split"))
    b = PR.evaluate(PR.rule_score(_features(spark, sf_dir, P.SCORE_ANCHORS))).withColumn("dataset", F.lit("out_of_time"))
    both = a.unionByName(b)
    return both.select("dataset", *[F.round(c, 6).alias(c) for c in both.columns if c != "dataset"])


def nested_param_daily(spark, sf_dir):
    """Daily figures from nested parameters: export shape, shard and date bounds, extraction, aggregation."""
    export = D.nested_export(_events(spark, sf_dir))
    flat = G.to_flat(G.scan_shards(export, *P.PERIOD))
    return flat.groupBy("event_date", "event_name").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_pseudo_id", "ga_session_id").alias("sessions"),
        F.count("page_location").alias("with_page"), F.count("raw_url").alias("with_raw_url"),
        F.count_distinct("page_location").alias("pages"), F.count_if(F.col("payment_type") == "total").alias("paid_in_full"),
        F.count("p_journey_code").alias("with_journey"), F.max("event_ts").alias("last_at"))


def daily_tables_report(spark, sf_dir):
    """The export as it lies, one table a day: written, bounded by table names and dates, read back, summed by day.

    Each call writes the tables anew beside the last ones, which a reader may still hold."""
    root = warehouse_dir(spark, f"export-{uuid.uuid4().hex}")
    G.write_daily(D.nested_export(_events(spark, sf_dir)), root)
    flat = G.read_export(spark, f"{root}/events_*", *P.EXPORT_PERIOD)
    return flat.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_pseudo_id").alias("users"),
        F.count_distinct("user_pseudo_id", "ga_session_id").alias("sessions"), F.count("page_location").alias("with_page"),
        F.count_if(F.col("event_name") == V.PAGE_VIEW).alias("page_views"), F.min("event_ts").alias("first_at"))


def param_names(spark, sf_dir):
    """Names and type slots of the parameters that every event comes with."""
    return Q.param_names(D.nested_export(_events(spark, sf_dir)))


def param_formats(spark, sf_dir):
    """The most frequent value formats of every parameter (digits kept as 9, letters folded)."""
    return Q.param_formats(D.nested_export(_events(spark, sf_dir)), top=P.FORMATS_PER_PARAM)


PARAM_COLUMNS = ["ga_session_id", "page_location", "lead_name", "payment_type", "booking_status",
                 "p_journey_is_destex", "p_journey_code", "p_departure_date", "p_sub_category",
                 "experiment_id", "variation_id", "cta_name", "cta_type", "voyage_funnel_step_name",
                 "uwrid", "market", "ab_component_tests"]


def param_coverage(spark, sf_dir):
    return Q.param_coverage(_events(spark, sf_dir), PARAM_COLUMNS, by=["event_name"])


_RAW_QUERIES: dict[str, Query] = {
    "sessions_before_conversion": sessions_before_conversion,
    "sessions_before_hist": sessions_before_hist,
    "days_before_conversion": days_before_conversion,
    "first_visit_to_action": first_visit_to_action,
    "page_path_backward": page_path_backward,
    "page_path_backward_hold": page_path_backward_hold,
    "page_path_backward_purchase": page_path_backward_purchase,
    "suite_funnel": suite_funnel,
    "journey_pages": journey_pages,
    "departure_global": departure_global,
    "departure_by_dest": departure_by_dest,
    "departure_hist": departure_hist,
    "departure_hist_by_dest": departure_hist_by_dest,
    "ab_report": ab_report,
    "ab_sample": ab_sample,
    "ab_clean_users": ab_clean_users,
    "component_variant": component_variant,
    "lead_funnel_by_step": lead_funnel_by_step,
    "lead_step_labels": lead_step_labels,
    "identity_coverage": identity_coverage,
    "key_match": key_match,
    "id_from_url": id_from_url,
    "source_date_ranges": source_date_ranges,
    "prospect_segments": prospect_segments,
    "audience_compare": audience_compare,
    "audience_side_by_side": audience_side_by_side,
    "visits_rollup": visits_rollup,
    "propensity_features": propensity_features,
    "propensity_scoring": propensity_scoring,
    "propensity_split": propensity_split,
    "propensity_lift": propensity_lift,
    "propensity_segments": propensity_segments,
    "propensity_train_predict": propensity_train_predict,
    "propensity_evaluate": propensity_evaluate,
    "propensity_importance": propensity_importance,
    "propensity_score_contract": propensity_score_contract,
    "propensity_rule_metrics": propensity_rule_metrics,
    "nested_param_daily": nested_param_daily,
    "daily_tables_report": daily_tables_report,
    "param_coverage": param_coverage,
    "param_names": param_names,
    "param_formats": param_formats,
}

QUERIES: dict[str, Query] = {k: _present(v) for k, v in _RAW_QUERIES.items()}
