"""A hot user (most of the rows) must not become one window partition."""
import random
import re

from tests.helpers import events_df, ev
from tests.test_sessions import _brute
from wayfare.operators import sessions as S


def _hot_fixture():
    rnd = random.Random(5)
    rows, eid = [], 0
    for u, days, per_day in [("hot", 40, 30)] + [(f"u{i}", 5, 3) for i in range(10)]:
        for d in range(days):
            for _ in range(per_day):
                eid += 1
                day = 1 + d % 28
                month = 1 + d // 28
                t = f"2024-{month:02d}-{day:02d} {rnd.randint(0, 23):02d}:{rnd.randint(0, 59):02d}:{rnd.randint(0, 59):02d}"
                name = rnd.choice(["page_view"] * 8 + ["generate_lead", "purchase"])
                rows.append(ev(eid, u, t, name, int(t[:10].replace("-", "")) * 10 + rnd.randint(0, 2),
                               lead_name="booking", p_journey_is_destex="NO", payment_type="free"))
    return rows


def test_hot_user_results_and_plan(spark):
    df = events_df(spark, _hot_fixture())
    acts, sess = S.conversions(df), S.sessions(df)
    per = S.sessions_before_conversion(acts, sess)
    got = {(r.user_pseudo_id, r.action_type, r.action_ts): r.sessions_before_action for r in per.collect()}
    a = [{"u": r.user_pseudo_id, "type": r.action_type, "t": r.action_ts} for r in acts.collect()]
    s = [(r.user_pseudo_id, r.session_id, r.session_start_ts) for r in sess.collect()]
    assert got == _brute(a, s)

    plan = per._jdf.queryExecution().executedPlan().toString()
    for spec in re.findall(r"windowspecdefinition\(([^)]*)\)", plan):
        if "user_pseudo_id" in spec:
            # user-keyed windows are either split by time bucket or run over per-bucket totals
            assert "_rb_bucket" in spec, spec


def _one_hot_session(n=4000, seconds=7000):
    """One session with n events in two hours, and a few small ones."""
    rnd = random.Random(8)
    rows = []
    for i in range(n):
        s = i * seconds // n
        name = rnd.choice(["page_view"] * 6 + ["generate_lead_RAQ", "request_quote_confirmation"])
        rows.append(ev(i, "hot", f"2024-01-05 {8 + s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}", name, 1,
                       page_location=rnd.choice(["/en/booking?step=suites", "/a", "/a", "/b", "/my", None]), p_journey_code="J1",
                       p_departure_date=rnd.choice(["2024-03-01", "01-04-2024", "n/a"])))
    for u in range(5):
        rows.append(ev(n + u, f"u{u}", "2024-01-05 09:00:00", "page_view", 2, page_location="/en/booking?step=suites"))
    return rows


def _own(rows, user="hot"):
    return sorted((r for r in rows if r["user_pseudo_id"] == user), key=lambda r: (r["event_timestamp"], r["event_id"]))


def test_hot_session_in_journeys(spark):
    from wayfare.operators import paths as PA
    rows = _one_hot_session()
    got = {r.user_pseudo_id: r for r in PA.journey_pages(events_df(spark, rows)).collect()}
    pages = [r["page_location"] for r in _own(rows) if r["event_name"] == "page_view" and r["page_location"]]
    pages = [p for i, p in enumerate(pages) if i == 0 or pages[i - 1] != p][:10]
    assert [got["hot"][f"page_{i}"] for i in range(1, 11)] == pages and got["hot"].has_RAQ == 1
    assert got["u3"].page_1 == "/en/booking?step=suites" and got["u3"].page_2 is None


def test_hot_session_in_the_funnel(spark):
    from wayfare.operators import funnel as FU
    rows = _one_hot_session()
    got = {r.user_pseudo_id: r for r in FU.suite_funnel(events_df(spark, rows)).collect()}
    own = _own(rows)
    first = next(r for r in own if r["event_name"] == "page_view" and r["page_location"] == "/en/booking?step=suites")
    after = [r for r in own if r["event_timestamp"] > first["event_timestamp"]
             and r["event_name"] in ("page_view", "request_quote_confirmation")][:10]
    assert [got["hot"][f"pv_{i}"] for i in range(1, 11)] == [
        "RAQ" if r["event_name"] == "request_quote_confirmation" else r["page_location"] for r in after]
    assert got["hot"].flag_raq == 1 and got["u0"].pv_1 is None


def test_hot_user_in_destination_inheritance(spark):
    from wayfare.operators import departure as DP
    rnd = random.Random(9)
    rows = [ev(i, "hot", f"2024-01-{1 + i % 20:02d} {i % 24:02d}:{i % 60:02d}:00", "page_view", i % 20,
               page_location=rnd.choice(["https://s/en/journeys/x", "https://booking.cruise-line.test/touchb2c/y"]),
               p_departure_date="2024-03-01", p_sub_category=rnd.choice(["north", "south", None, None])) for i in range(3000)]
    views = DP.classified_views(events_df(spark, rows))
    got = {(r.page_group, r.final_sub_category): r.total_pageviews for r in DP.departure_summary(views, by_destination=True).collect()}
    own, want = _own(rows), {}
    is_itin = lambda r: "journeys/" in r["page_location"]
    last = {}
    for r in own:
        if is_itin(r) and r["p_sub_category"]:
            last[r["ga_session_id"]] = last["any"] = r["p_sub_category"]
    for r in own:
        dest = (r["p_sub_category"] if is_itin(r) else None) or last.get(r["ga_session_id"]) or last["any"]
        key = ("Itinerary Page" if is_itin(r) else "Funnel", dest)
        want[key] = want.get(key, 0) + 1
    assert got == want
