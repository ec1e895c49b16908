"""Invariants the original analyses were checked with by hand, run on driver tables."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from wayfare.operators import propensity as PR
from wayfare.operators import sessions as S
from wayfare.sources import driver as D

SF = "/root/testdata/sf0.01"


def test_funnel_flags_reconcile(spark):
    f = E.queries()["suite_funnel"](spark, SF)
    flags = [c for c in f.columns if c.startswith("flag_")]
    anyf = F.greatest(*[F.col(c) for c in flags])
    r = f.agg(F.count(F.lit(1)).alias("users"), F.count_if(anyf == 1).alias("any"),
              F.count_if(anyf == 0).alias("none")).collect()[0]
    assert r.users > 0 and r.any + r.none == r.users


def test_prospect_classes_sum_to_control_total(spark):
    rows = {r.categoria: r.users for r in E.queries()["prospect_segments"](spark, SF).collect()}
    total = [v for k, v in rows.items() if k.startswith("TOTALE")][0]
    assert sum(v for k, v in rows.items() if not k.startswith("TOTALE")) == total > 0


def test_first_action_days_agree_with_no_reset_variant(spark):
    ev = D.read_events(spark, SF).filter(F.col("ga_session_id").isNotNull())
    acts = S.conversions(ev)
    per = S.days_before_conversion(acts, S.sessions(ev))
    first = per.groupBy("user_pseudo_id", "action_type").agg(F.min_by("days", "action_ts").alias("d_reset"))
    fa = acts.groupBy("user_pseudo_id", "action_type").agg(F.min("action_ts").alias("t"))
    fv = ev.groupBy("user_pseudo_id").agg(F.min("event_timestamp").alias("v"))
    nr = fa.join(fv, "user_pseudo_id").select("user_pseudo_id", "action_type",
                                              F.expr("(t - v) div 86400000000").alias("d_first"))
    j = first.join(nr, ["user_pseudo_id", "action_type"])
    assert j.count() > 0 and j.filter(F.col("d_reset") != F.col("d_first")).count() == 0


def test_queries_are_deterministic(spark):
    for k in ("page_path_backward", "propensity_segments", "ab_sample"):
        a = E.queries()[k](spark, "/root/testdata/sf0.001")
        b = E.queries()[k](spark, "/root/testdata/sf0.001")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_label_coverage_flags_truncated_labels(spark):
    ev = D.read_events(spark, SF)
    ok = PR.label_coverage(ev, "2024-01-16", 14).collect()[0]
    late = PR.label_coverage(ev, "2024-01-20", 14).collect()[0]
    assert ok.covered is True and late.covered is False


def test_check_labels_raises_on_truncated_labels(spark):
    import pytest
    ev = D.read_events(spark, SF)
    PR.build_features(ev, "2024-01-04", "2024-01-16", 3, check_labels=True)
    with pytest.raises(ValueError):
        PR.build_features(ev, "2024-01-04", "2024-01-20", 3, check_labels=True)
