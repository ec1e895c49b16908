"""Optimised operators vs straightforward pair-join implementations on random fixtures
(with timestamp ties, sessions starting exactly at the action, NULL session ids)."""
import random

from tests.helpers import events_df, ev
from wayfare.operators import paths as PA
from wayfare.operators import sessions as S

PAGES = ["/a", "/b", "/c", "/d"]


def _fixture(seed: int, users: int = 4, days: int = 9):
    rnd = random.Random(seed)
    rows, eid = [], 0
    for u in range(users):
        for d in range(1, days + 1):
            minutes = sorted(rnd.sample(range(0, 120), 6))
            for m in minutes:
                eid += 1
                name = rnd.choice(["page_view"] * 4 + ["generate_lead", "purchase"])
                sess = None if rnd.random() < 0.08 else (d * 10 + (m // 60))     # two sessions per day
                rows.append(ev(eid, f"u{u}", f"2024-01-{d:02d} 10:{m % 60:02d}:00".replace(
                    "10:", f"{10 + m // 60}:"), name, sess, page_location=rnd.choice(PAGES),
                    lead_name="booking", p_journey_is_destex="NO", payment_type="free"))
    return rows


def _is_action(r):
    return (r["event_name"] == "generate_lead" and r["lead_name"] == "booking") or (
        r["event_name"] == "purchase" and r["p_journey_is_destex"] != "YES" and r["payment_type"] != "total")


def _paths_by_hand(rows, depth):
    """{(url, position): conversions} by walking every conversion's sessions and their pages."""
    seen = set()
    for u in {r["user_pseudo_id"] for r in rows}:
        own = [r for r in rows if r["user_pseudo_id"] == u]
        start = {}
        for r in own:
            s = r["ga_session_id"]
            if s is not None:
                start[s] = min(start.get(s, r["event_timestamp"]), r["event_timestamp"])
        before = float("-inf")
        for t in sorted({r["event_timestamp"] for r in own if _is_action(r)}):
            at = {r["ga_session_id"] for r in own if _is_action(r) and r["event_timestamp"] == t} - {None}
            earlier = sorted((v, s) for s, v in start.items() if before < v < t and at and s != min(at))[::-1][:depth]
            places = [(s, -i) for i, (_, s) in enumerate(earlier, 1)] + [(s, 0) for s in at]
            for s, place in places:
                seen |= {(u, t, place, r["page_location"]) for r in own
                         if r["ga_session_id"] == s and r["event_name"] == "page_view" and r["page_location"] is not None
                         and (place or r["event_timestamp"] < t)}
            before = t
    out = {}
    for *_, place, url in seen:
        out[url, place] = out.get((url, place), 0) + 1
    return out


def _paths(df, depth):
    return {(r.page_url, -i): r[f"session_minus_{i}"] for r in PA.page_path_backward(df, depth=depth).collect()
            for i in range(depth + 1) if r[f"session_minus_{i}"]}


def test_page_path_matches_walking_every_conversion(spark):
    for seed in (1, 2):
        rows = _fixture(seed)
        assert _paths(events_df(spark, rows), 3) == _paths_by_hand(rows, 3)


def test_page_path_with_repeated_timestamps(spark):
    rows = _fixture(3)
    rnd, again = random.Random(3), []
    for n, r in enumerate(rows):
        if n % 3 == 0:      # a second event of the instant, at times in another session
            again.append({**r, "event_id": 10_000 + n, "ga_session_id": rnd.choice([r["ga_session_id"], r["ga_session_id"], 7, None])})
    rows += again
    assert _paths(events_df(spark, rows), 3) == _paths_by_hand(rows, 3)


def test_two_holds_at_one_instant_are_one_occurrence(spark):
    for other in (3, 9):        # same and different session
        rows = [ev(1, "u", "2024-01-01 10:00:00", "page_view", 1, page_location="/a"),
                ev(2, "u", "2024-01-02 10:00:00", "page_view", 2, page_location="/b"),
                ev(3, "u", "2024-01-03 10:00:00", "page_view", 3, page_location="/c"),
                ev(4, "u", "2024-01-03 10:05:00", "generate_lead", 3, lead_name="booking"),
                ev(5, "u", "2024-01-03 10:05:00", "generate_lead", other, lead_name="booking")]
        df = events_df(spark, rows)
        acts, sess = S.conversions(df, total_label=None), S.sessions(df)
        assert [r.sessions_before_action for r in S.sessions_before_conversion(acts, sess).collect()] == [3 if other == 3 else 4]
        assert [r.days for r in S.days_before_conversion(acts, sess).collect()] == [2]
        assert _paths(df, 3) == {("/b", -1): 1, ("/a", -2): 1, ("/c", 0): 1} == _paths_by_hand(rows, 3)


def test_page_path_of_a_hot_session_stays_linear(spark):
    """1,000 conversions and 10,000 views of one session never meet pairwise."""
    base = ev(0, "u", "2024-01-01 00:00:00", "page_view", 1, lead_name="booking")
    hot = events_df(spark, [{**base, "event_id": n, "event_timestamp": base["event_timestamp"] + n * 1000, "page_location": f"/p{n % 50}",
                             "event_name": "page_view" if n % 11 else "generate_lead"} for n in range(11_000)])
    out = PA.page_path_backward(hot, depth=3)
    got = {r.page_url: r.session_minus_0 for r in out.collect()}
    want = {}
    for url in range(50):
        first = next(i for i in range(11_000) if i % 11 and i % 50 == url)
        want[f"/p{url}"] = sum(1 for i in range(0, 11_000, 11) if i > first)
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_session_counts_with_ties(spark):
    # a session starting exactly at the action counts (<=); two sessions sharing a start both count
    rows = [
        ev(1, "u", "2024-01-01 10:00:00", "page_view", 1),
        ev(2, "u", "2024-01-01 10:00:00", "page_view", 2),            # same start as session 1
        ev(3, "u", "2024-01-01 11:00:00", "generate_lead", 3, lead_name="booking"),   # session 3 starts here
        ev(4, "u", "2024-01-01 12:00:00", "page_view", 4),
        ev(5, "u", "2024-01-01 12:00:00", "generate_lead", 5, lead_name="booking"),  # tie with session 4 start
    ]
    df = events_df(spark, rows)
    per = S.sessions_before_conversion(S.conversions(df, total_label=None), S.sessions(df))
    got = sorted(r.sessions_before_action for r in per.collect())
    assert got == [2, 3]   # 12:00 -> sessions 4, 5 in (11:00, 12:00]; 11:00 -> sessions 1, 2, 3
    days = S.days_before_conversion(S.conversions(df, total_label=None), S.sessions(df))
    assert sorted(r.window_start_ts for r in days.collect())[0] == rows[0]["event_timestamp"]
