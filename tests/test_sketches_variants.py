"""Merged quantile sketches against exact medians; component variants in every spelling of their JSON."""
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import ev, events_df
from wayfare.operators import departure as DP
from wayfare.operators import experiment as X
from wayfare.operators import sessions as S
from wayfare.operators import sketches as K
from wayfare.sources.driver import read_events



def _rank_off(values, x):
    """How far from the middle the nearest place of ``x`` among the sorted values lies, as a share."""
    below, upto = sum(v < x for v in values), sum(v <= x for v in values)
    middle = (len(values) - 1) // 2
    return max(0.0, below - middle, middle - (upto - 1)) / len(values)


def _within(rows, keys, value, report, k):
    groups = {}
    for r in rows:
        groups.setdefault(tuple(r[c] for c in keys), []).append(r[value])
    got = {tuple(r[c] for c in keys): r for r in report.collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        r = got[g]
        assert (r.n, r.least, r.greatest) == (len(values), min(values), max(values)) and abs(r["mean"] - sum(values) / len(values)) < 1e-9
        assert r["median"] in set(values) and _rank_off(values, r["median"]) <= K.rank_error(k)


@pytest.mark.parametrize("period", [(None, None), ("2024-01-05", "2024-01-12"), ("2024-01-20", None)])
def test_departure_report_of_any_period_from_daily_sketches(spark, period):
    import datetime as dt
    days = DP.departure_days(DP.classified_views(read_events(spark, "/root/testdata/sf0.01")), by_destination=True)
    keys = ["page_group", "final_sub_category"]
    daily = K.daily_sketches(days, keys, "visit_date", "days_before", k=200)
    lo, hi = (dt.date.fromisoformat(d) if d else None for d in period)
    rows = [r for r in days.collect() if (lo is None or r.visit_date >= lo) and (hi is None or r.visit_date <= hi)]
    _within(rows, keys, "days_before", K.period_summary(daily, keys, lo, hi), 200)


def test_sessions_report_from_daily_sketches(spark):
    events = read_events(spark, "/root/testdata/sf0.01")
    per = S.sessions_before_conversion(S.conversions(events), S.sessions(events)).withColumn(
        "day", F.to_date(F.timestamp_micros("action_ts"))).cache()
    daily = K.daily_sketches(per, ["action_type"], "day", "sessions_before_action")
    report = K.period_summary(daily, ["action_type"])
    _within(per.collect(), ["action_type"], "sessions_before_action", report, K.K)
    exact = {r.action_type: r.median_sessions_before for r in S.summarize_sessions_before(per).collect()}
    small = {r.action_type: r["median"] for r in report.collect() if r.n <= K.K}
    assert all(exact[a] == m for a, m in small.items())


def test_error_of_many_merged_days(spark):
    rng = random.Random(3)
    rows = [("g", d, int(rng.lognormvariate(5, 2))) for d in range(40) for _ in range(rng.randint(1, 1500))] + [("one", 1, 7), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, d int, v long").repartition(6)
    for k in (200, 800):
        report = K.period_summary(K.daily_sketches(df, ["g"], "d", "v", k), ["g"])
        _within([r for r in df.collect() if r.v is not None], ["g"], "v", report, k)


def test_variants_in_any_spelling(spark):
    texts = {"a": '{"test":"t","s":"b"}', "spaces": '{ "test" : "t" , "s" : "b" }', "order": '{"segmentId": "b", "x": 1, "test": "t"}',
             "list": '[{"test":"u","s":"a"},{"test":"t","s":"b"}]', "nested": '{"test":"t","s":{"s":"b"}}', "broken": '{"test":"t","s":"b"',
             "two": '[{"test":"u","s":"b"},{"test":"t","s":"a"}]', "none": None, "empty": "", "number": "5", "text": '"t"', "nul": '{"test":"t","s":null}',
             "other": '{"test":"t2","s":"b"}'}
    rows = [ev(i, u, "2024-01-01 10:00:00", "page_view", 1, ab_component_tests=t) for i, (u, t) in enumerate(texts.items())]
    events = events_df(spark, rows)
    assert {r.user_pseudo_id for r in X.component_variant(events, "t", "b").collect()} == {"a", "spaces", "order", "list"}
    by_text = {r.user_pseudo_id for r in X.component_variant(events, "t", "b", strict=False).collect()}
    assert by_text == {"a", "list", "nested", "broken", "two", "other"}
    keyed = X.component_variant(events, "t", "b", variant_keys=("segmentId",)).collect()
    assert [r.user_pseudo_id for r in keyed] == ["order"]
