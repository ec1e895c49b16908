import random

from pyspark.sql import functions as F

from wayfare.operators.ordered import running_aggregate
from wayfare.operators.stats import group_median


def test_group_median_exact_with_hot_group_ties_and_null_key(spark):
    rnd = random.Random(1)
    rows = [("hot", float(rnd.choice([5, 5, 5, 7, 100, rnd.randint(0, 1000)]))) for _ in range(20000)]
    rows += [("g2", float(rnd.randint(0, 50))) for _ in range(8)] + [(None, 3.0), (None, 9.0), ("one", 4.0)]
    rows += [("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in group_median(df, ["g"], "v").collect()}
    ref = {r.g: r.m for r in df.filter(F.col("v").isNotNull()).groupBy("g")
           .agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert got == ref


def test_group_summary_of_any_values(spark):
    from wayfare.operators.stats import group_summary
    rnd = random.Random(2)
    rows = [("neg", rnd.uniform(-1e6, 1e6)) for _ in range(999)] + [("wide", 10.0 ** rnd.randint(-300, 300)) for _ in range(500)]
    rows += [("two", 1.0), ("two", 1e9), ("zero", 0.0), ("zero", -0.0), ("zero", 5e-324)] + [("many", float(i)) for i in range(2001)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.n, r.min, r.max, r.median) for r in group_summary(df, ["g"], "v").collect()}
    ref = {r.g: (r.n, r.lo, r.hi, r.m) for r in df.groupBy("g").agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile("v", 0.5).alias("m")).collect()}
    assert got == ref


def test_running_aggregate_independent_of_bucket_width(spark):
    rnd = random.Random(11)
    data = [("k", rnd.randint(0, 10 * 86_400_000_000), rnd.randint(0, 5)) for _ in range(600)]
    df = spark.createDataFrame(data, "k string, t long, v long").withColumn("id", F.monotonically_increasing_id())
    outs = []
    for width in (3_600_000_000, 86_400_000_000, 10**18):
        r = running_aggregate(df, ["k"], "t", "v", ["le", "lt"], agg="sum", frame=["le", "lt"], bucket_micros=width)
        outs.append({x.id: (x.le, x.lt) for x in r.collect()})
    assert outs[0] == outs[1] == outs[2]


def test_audience_median_modes_agree(spark):
    from wayfare.operators import audience as AU
    from wayfare.sources import driver as D
    ev = D.read_events(spark, "/root/testdata/sf0.01")
    seg, leads = D.visitor_segments(ev), D.visit_leads(ev)
    left, right = F.col("segment") == "seg_A", F.col("segment") == "seg_B"

    def run(mode):
        df = AU.compare_audiences(seg, leads, left, right, median=mode)
        return {(r.side, r.web_request_type): (r.median_booking_value, r.min_booking_value, r.max_booking_value)
                for r in df.collect()}
    exact, pct, approx = run("exact"), run("percentile"), run("approx")
    assert exact == pct and set(approx) == set(exact)
    assert all(lo <= m <= hi for m, lo, hi in approx.values())


def test_values_close_together_never_meet_in_one_window(spark, monkeypatch):
    """200,000 distinct values in [1000, 1010): the bound on a window's rows holds, the median is exact."""
    from wayfare.operators import stats
    seen = []
    pick = stats._pick
    monkeypatch.setattr(stats, "_pick", lambda ranges, keys, order: seen.append((ranges, keys)) or pick(ranges, keys, order))
    df = spark.range(200_000).select((F.lit(1000.0) + F.col("id") / 20_000).alias("v"), F.lit("g").alias("g"))
    df = df.union(df.filter("v < 1001")).union(spark.range(50).select(F.lit(1e-3), F.lit("h")))
    got = {r.g: r.median for r in stats.group_median(df, ["g"], "v").collect()}
    assert got == {r.g: r.m for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect()}
    assert len(seen) == stats.REFINEMENTS + 1
    for ranges, keys in seen:
        assert ranges.groupBy(*keys, "_t").count().agg(F.max("count")).first()[0] <= stats.SPLITS
    assert seen[-1][0].groupBy("g", "_t").count().agg(F.max("count")).first()[0] < 100


def test_neighbouring_doubles_are_told_apart(spark):
    import math
    from wayfare.operators import stats
    rows, x = [], 1000.0
    for i in range(301):
        rows.append(("a", x))
        rows += [("b", -x)] * (i % 3)
        x = math.nextafter(x, math.inf)
    rows += [("c", float("nan")), ("c", 1.0), ("c", float("inf")), ("d", float("inf")), ("d", float("-inf")), ("d", float("-inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: str(r.median) for r in stats.group_median(df, ["g"], "v").collect()}
    assert got == {r.g: str(r.m) for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m")).collect()}


def test_money_totals_do_not_depend_on_the_order(spark):
    from wayfare.operators import stats
    rows = [("g", round(0.1 * i, 2)) for i in range(5000)] + [("g", 1e12), ("g", -1e12)]
    totals = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        totals.add(stats.group_summary(spark.createDataFrame(rows, "g string, v double").repartition(7), ["g"], "v", money=True).first().total)
    assert totals == {round(sum(int(round(v * 100)) for _, v in rows) / 100, 2)}
