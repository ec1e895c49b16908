"""Names, type slots, formats and sample values of nested parameters against plain Python."""
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wayfare.operators import quality as Q

SCHEMA = ("event_name string, day string, event_params array<struct<key:string,value:struct<string_value:string,int_value:long,"
          "float_value:double,double_value:double>>>")


def _hits(seed=1, n=400):
    rng, out = random.Random(seed), []
    for _ in range(n):
        params = []
        for _ in range(rng.randint(0, 5)):
            key = rng.choice(["page", "date", "id", "odd"])
            value = {"page": (rng.choice(["/a", "/été", "", "/b2"]), None, None, None),
                     "date": (rng.choice(["2024-05-01", "01-05-2024", "1 maggio 2024", None]), None, None, None),
                     "id": (None, rng.randint(-5, 2000), None, None),
                     "odd": rng.choice([("x", 1, None, None), (None, None, 1.5, None), (None, None, None, 2.5), ("7", None, None, None)])}[key]
            params.append((key, value))
        out.append((rng.choice(["page_view", "purchase", None]), rng.choice(["1", "2", "3"]), rng.choice([params, params, params, None])))
    return out


def test_names_and_slots(spark):
    hits = _hits()
    events, want = Counter(h[0] for h in hits), defaultdict(Counter)
    for name, _, params in hits:
        seen = Counter()
        for key, value in params or []:
            w = want[name, key]
            w["with_name"] += key not in seen
            w["repeated"] += key in seen
            seen[key] += 1
            for slot, v in zip(Q.SLOTS, value):
                w[f"{slot}_values"] += v is not None
            w["empty_strings"] += value[0] == ""
            w["without_value"] += not any(v is not None for v in value)
            w["several_values"] += sum(v is not None for v in value) > 1
    got = Q.param_names(spark.createDataFrame(hits, SCHEMA)).collect()
    assert {(r.event_name, r.param) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        w = want[r.event_name, r.param]
        assert r.events == events[r.event_name] and r.coverage_pct == round(w["with_name"] / r.events * 100, 2)
        assert {c: r[c] for c in r.asDict() if c not in ("event_name", "param", "events", "coverage_pct")} == {
            c: w[c] for c in ("with_name", *[f"{s}_values" for s in Q.SLOTS], "empty_strings", "without_value", "several_values", "repeated")}


@pytest.mark.parametrize("top", [None, 2])
def test_formats(spark, top):
    hits, want = _hits(2), defaultdict(list)
    for _, _, params in hits:
        for key, value in params or []:
            for slot, v in zip(Q.SLOTS, value):
                if v is not None:
                    text = str(v)
                    want[key, slot, re.sub("[0-9]", "9", re.sub(r"[^\W\d_]+", "a", text))].append(text)
    totals = Counter()
    for (key, slot, _), values in want.items():
        totals[key, slot] += len(values)
    if top:
        ranked = sorted(want, key=lambda k: (k[0], k[1], -len(want[k]), k[2]))
        want = {k: want[k] for k in ranked if sum(o[:2] == k[:2] for o in ranked[:ranked.index(k)]) < top}
    got = Q.param_formats(spark.createDataFrame(hits, SCHEMA), top).collect()
    assert {(r.param, r.slot, r.format): (r["values"], r.share_pct, r.least, r.greatest) for r in got} == {
        k: (len(v), round(len(v) / totals[k[:2]] * 100, 2), min(v), max(v)) for k, v in want.items()}
    assert {r.format for r in got if r.param == "date"} >= ({"9999-99-99", "99-99-9999", "9 a 9999"} if not top else set())


def test_exports_without_every_slot(spark):
    df = spark.createDataFrame([("e", [("k", ("v", 3))])], "event_name string, event_params array<struct<key:string,value:struct<string_value:string,int_value:long>>>")
    assert Q.slots_of(df) == ["string", "int"]
    r = Q.param_names(df).first()
    assert (r.string_values, r.int_values, r.several_values) == (1, 1, 1)
    assert Q.param_names(df.limit(0)).collect() == [] and Q.param_formats(df.limit(0)).collect() == []


def test_sketches_of_days_merge(spark):
    hits = _hits(3, 1500)
    raw = spark.createDataFrame(hits, SCHEMA)
    by_day = Q.sample_sketches(raw, ["day"])
    got = {(r.param, r.value): r.n for r in Q.param_samples(by_day, k=3).collect()}
    counts = defaultdict(Counter)
    for _, _, params in hits:
        for key, value in params or []:
            v = next((v for v in value if v is not None), None)
            if v is not None:
                counts[key][str(v)] += 1
    for key, c in counts.items():
        mine = {v: n for (p, v), n in got.items() if p == key}
        if len(c) <= 750:                                   # counted exactly
            assert sorted(mine.values(), reverse=True) == sorted(c.values(), reverse=True)[:3] and all(c[v] == n for v, n in mine.items())
    two = Q.param_samples(by_day.filter(F.col("day") < "3"), k=1)
    assert {r.param for r in two.collect()} == set(counts)


def test_a_sketch_of_very_many_values_stays_within_its_bound(spark):
    tracked, n = 100, 20_000
    raw = spark.range(n).select(F.lit("e").alias("event_name"), F.array(F.struct(F.lit("k").alias("key"), F.struct(
        F.when(F.col("id") % 4 == 0, "often").when(F.col("id") % 10 == 1, "sometimes").otherwise(F.concat(F.lit("v"), "id")).alias("string_value"))
        .alias("value"))).alias("event_params"), (F.col("id") % 5).cast("string").alias("day"))
    got = {r.value: r.n for r in Q.param_samples(Q.sample_sketches(raw, ["day"], tracked=tracked), k=2, tracked=tracked).collect()}
    exact = {"often": n // 4, "sometimes": sum(i % 4 != 0 and i % 10 == 1 for i in range(n))}
    assert set(got) == set(exact)
    assert all(abs(got[v] - exact[v]) <= 3.5 * n / tracked for v in exact)


def test_formats_read_the_events_once_and_count_repeated_values(spark):
    row = [("k", ("a1", None, None, None)), ("k", ("a1", None, None, None)), ("k", ("b22", None, None, None)), ("n", (None, 7, None, None)),
           (None, ("x", None, None, None)), ("e", (None, None, None, None))]
    raw = spark.createDataFrame([(row,)] * 3 + [(None,), ([],), ([None],)],
                                "event_params array<struct<key:string,value:struct<string_value:string,int_value:bigint,float_value:double,double_value:double>>>")
    got = Q.param_formats(raw, 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [("k", "string", "a9", 6, 66.67, "a1", "a1"), ("n", "int", "9", 3, 100.0, "7", "7")]
    assert sorted(tuple(r) for r in Q.param_formats(raw).collect()) == [
        ("k", "string", "a9", 6, 66.67, "a1", "a1"), ("k", "string", "a99", 3, 33.33, "b22", "b22"), ("n", "int", "9", 3, 100.0, "7", "7")]
    assert plan.count("Scan ExistingRDD") == 1
    # a value is counted, by a hash, before its format is made
    assert "keys=[param" in plan and "value#" in next(x for x in reversed(plan.splitlines()) if "Aggregate" in x)
