import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.helpers import events_df, ev
from wayfare.operators import sessions as S
from wayfare.operators.ordered import running_aggregate


def _brute(actions, sess):
    """Reference semantics in plain Python: sessions started in (prev, t]."""
    out = {}
    by = {}
    for a in actions:
        by.setdefault((a["u"], a["type"]), []).append(a["t"])
    for (u, typ), ts in by.items():
        ts.sort()
        prev = None
        for t in ts:
            n = len({sid for (uu, sid, st) in sess if uu == u and st <= t and (prev is None or st > prev)})
            if n:
                out[(u, typ, t)] = n
            prev = t
    return out


def test_reset_logic_edge_rows(spark):
    rows = [
        # user a: session 1 (two holds in one session), session 2, session 3 (purchase)
        ev(1, "a", "2024-01-01 10:00:00", "page_view", 20240101),
        ev(2, "a", "2024-01-01 10:05:00", "generate_lead", 20240101, lead_name="booking"),
        ev(3, "a", "2024-01-01 10:06:00", "generate_lead", 20240101, lead_name="booking"),
        ev(4, "a", "2024-01-02 09:00:00", "page_view", 20240102),
        ev(5, "a", "2024-01-03 09:00:00", "page_view", 20240103),
        ev(6, "a", "2024-01-03 09:30:00", "purchase", 20240103, p_journey_is_destex="NO", payment_type="free"),
        # user b: conversion without any session id
        ev(7, "b", "2024-01-01 08:00:00", "generate_lead", None, lead_name="booking"),
    ]
    df = events_df(spark, rows)
    per = S.sessions_before_conversion(S.conversions(df), S.sessions(df))
    got = {(r.user_pseudo_id, r.action_type, r.action_ts): r.sessions_before_action for r in per.collect()}
    m = {r["event_id"]: r["event_timestamp"] for r in rows}
    assert got[("a", "Booking Hold", m[2])] == 1
    assert ("a", "Booking Hold", m[3]) not in got            # second conversion in the same session
    assert got[("a", "Purchase", m[6])] == 3                 # no previous purchase: all sessions
    assert got[("a", "Any (OR)", m[6])] == 2                 # reset after the hold for "Any"
    assert not any(k[0] == "b" for k in got)                 # no session -> dropped


def test_matches_brute_force_random(spark):
    rnd = random.Random(7)
    rows, eid = [], 0
    for u in ["u1", "u2", "u3"]:
        for d in range(1, 8):
            for h in sorted(rnd.sample(range(0, 23), 4)):
                eid += 1
                name = rnd.choice(["page_view", "page_view", "generate_lead", "purchase"])
                rows.append(ev(eid, u, f"2024-01-0{d} {h:02d}:{rnd.randint(0, 59):02d}:00", name,
                               20240100 + d if rnd.random() > 0.1 else None,
                               lead_name="booking", p_journey_is_destex="NO", payment_type="free"))
    df = events_df(spark, rows)
    acts = S.conversions(df)
    sess = S.sessions(df)
    got = {(r.user_pseudo_id, r.action_type, r.action_ts): r.sessions_before_action
           for r in S.sessions_before_conversion(acts, sess).collect()}
    a = [{"u": r.user_pseudo_id, "type": r.action_type, "t": r.action_ts} for r in acts.collect()]
    s = [(r.user_pseudo_id, r.session_id, r.session_start_ts) for r in sess.collect()]
    assert got == _brute(a, s)


def test_running_aggregate_equals_plain_window(spark):
    rnd = random.Random(3)
    data = [(f"k{rnd.randint(0, 3)}", rnd.randint(0, 5 * 86_400_000_000), rnd.randint(0, 9)) for _ in range(400)]
    df = spark.createDataFrame(data, "k string, t long, v long").withColumn("id", F.monotonically_increasing_id())
    mine = running_aggregate(df, ["k"], "t", "v", ["s_le", "s_lt"], agg="sum", frame=["le", "lt"])
    mine = running_aggregate(mine, ["k"], "t", "v", "m_lt", agg="max", frame="lt")
    w = Window.partitionBy("k").orderBy("t")
    ref = df.select("id", F.sum("v").over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("s_le"),
                    F.coalesce(F.sum("v").over(w.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("s_lt"),
                    F.max("v").over(w.rangeBetween(Window.unboundedPreceding, -1)).alias("m_lt"))
    a = {r.id: (r.s_le, r.s_lt, r.m_lt) for r in mine.select("id", "s_le", "s_lt", "m_lt").collect()}
    b = {r.id: (r.s_le, r.s_lt, r.m_lt) for r in ref.collect()}
    assert a == b


def test_days_before_uses_24h_periods(spark):
    rows = [
        ev(1, "a", "2024-01-01 23:00:00", "page_view", 1),
        ev(2, "a", "2024-01-02 22:00:00", "generate_lead", 1, lead_name="booking"),   # 23 h later
        ev(3, "b", "2024-01-01 10:00:00", "page_view", 1),
        ev(4, "b", "2024-01-02 10:00:00", "generate_lead", 2, lead_name="booking"),   # 24 h later
    ]
    df = events_df(spark, rows)
    d = S.days_before_conversion(S.conversions(df, total_label=None), S.sessions(df))
    got = {r.user_pseudo_id: r.days for r in d.collect()}
    assert got == {"a": 0, "b": 1}


def test_with_previous_and_session_index_match_plain_windows(spark):
    rnd = random.Random(9)
    acts = spark.createDataFrame(
        [(f"u{rnd.randint(0, 2)}", rnd.choice(["A", "B"]), rnd.randint(0, 3 * 86_400_000_000)) for _ in range(200)],
        "user_pseudo_id string, action_type string, action_ts long").dropDuplicates(["user_pseudo_id", "action_ts"])
    mine = {(r.user_pseudo_id, r.action_type, r.action_ts): r.prev_action_ts for r in
            S.with_previous(acts, ["user_pseudo_id", "action_type"]).collect()}
    w = Window.partitionBy("user_pseudo_id", "action_type").orderBy("action_ts")
    ref = {(r.user_pseudo_id, r.action_type, r.action_ts): r.p for r in
           acts.select("*", F.lag("action_ts").over(w).alias("p")).collect()}
    assert mine == ref

    sess = spark.createDataFrame(
        [(f"u{rnd.randint(0, 2)}", i, rnd.randint(0, 3 * 86_400_000_000) // 1000 * 1000) for i in range(150)],
        "user_pseudo_id string, session_id long, session_start_ts long")
    got = {(r.user_pseudo_id, r.session_id): r.session_idx for r in S.session_index(sess).collect()}
    w2 = Window.partitionBy("user_pseudo_id").orderBy("session_start_ts", "session_id")
    exp = {(r.user_pseudo_id, r.session_id): r.i for r in sess.select("*", F.row_number().over(w2).alias("i")).collect()}
    assert got == exp
