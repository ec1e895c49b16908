"""Anchored feature windows against plain Python, and what their plan shuffles."""
import datetime as dt
import random
from collections import Counter

import pytest

from tests.helpers import ev, events_df
from wayfare.operators import propensity as PR
from wayfare.sources.driver import read_events

BASE = dt.date(2024, 3, 1)


def _events(seed, n=220):
    rng, out = random.Random(seed), []
    pages = [None, "https://s/cruises/it1", "https://s/cruises/it2?x=1", "https://s/destinations/d1/a", "https://s/destinations/d2",
             "https://quote.cruise-line.test/a/summary", "https://quote.cruise-line.test/a/guests-info", "https://s/home",
             "https://s/offers?utm_medium=email&utm_campaign=a_VS_b"]
    names = ["page_view", "page_view", "find_your_cruise_filter", "generate_lead_RAB", "generate_lead_RAQ", "generate_lead_SFO",
             "generate_lead_WEBQ", "generate_lead_WBOF_01"]
    for i in range(n):
        day = BASE + dt.timedelta(days=rng.choice([rng.randint(-40, 40), rng.randint(-3, 3)]))
        user = rng.choice(["a", "b", "c", None])
        # few sessions, so that one session has days far apart and sessions overlap
        session = rng.choice([None, 1, 2, 3, rng.randint(1, 30)])
        out.append(ev(i, user, f"{day} {rng.randint(0, 23):02d}:00:00", rng.choice(names), session,
                      page_location=rng.choice(pages), market=rng.choice([None, None, "US", "UK"])))
    return out


def _by_hand(rows, anchor, lookback, horizon):
    out = {}
    for u in {r["user_pseudo_id"] for r in rows} - {None}:
        mine = [dict(r, day=r["event_ts"].date(), page=r["page_location"] or "") for r in rows if r["user_pseudo_id"] == u]
        seen = [r for r in mine if 1 <= (anchor - r["day"]).days <= lookback]

        def recent(days):
            return sessions(lambda r: (anchor - r["day"]).days <= days)

        def vs(r):
            return "utm_medium=email" in r["page"] and "_VS_" in r["page"]

        def sessions(test=lambda r: True):
            return len({r["ga_session_id"] for r in seen if r["ga_session_id"] is not None and test(r)})

        def top(prefix):
            c = Counter(r["page"].split(prefix)[1].split("/")[0].split("?")[0] for r in seen if prefix in r["page"])
            best = min(c.items(), key=lambda x: (-x[1], x[0]), default=(None, 0))
            return best[1], best[0], int(len(c) > 1)

        def lead(kind):
            return sum(r["event_name"] == f"generate_lead_{kind}" for r in seen)
        v30, v7 = sessions(), recent(7)
        if not v30:
            continue
        it, de = top("/cruises/"), top("/destinations/")
        quotes = sum("quote.cruise-line.test" in r["page"] for r in seen)
        markets = [(r["event_timestamp"], r["event_id"], r["market"]) for r in seen if r["market"]]
        leads = [lead(k) for k in ("RAB", "RAQ", "SFO", "WEBQ")]
        target = any(r["event_name"] == "generate_lead_WBOF_01" and 0 <= (r["day"] - anchor).days <= horizon for r in mine)
        out[u] = (int(target), sessions(vs), sessions(lambda r: not vs(r)), v7, recent(14), v30,
                  sum("/cruises/" in r["page"] for r in seen), sum("/destinations/" in r["page"] for r in seen), it[0], de[0],
                  sum(r["event_name"] == "find_your_cruise_filter" for r in seen), *leads, quotes,
                  max(markets)[2] if markets else None, it[1], de[1], min((anchor - r["day"]).days for r in seen), v7 / v30,
                  sum(r["event_name"] == "page_view" for r in seen) / v30, int(sum(leads) > 0), quotes / v30, it[2], de[2],
                  int(any("quote.cruise-line.test" in r["page"] and "guests-info" in r["page"] for r in seen)))
    return out


@pytest.mark.parametrize("seed,step,lookback,horizon", [(0, 1, 30, 14), (1, 3, 30, 14), (2, 7, 30, 14), (3, 1, 20, 0), (4, 10, 15, 3), (5, 2, 45, 20), (6, 2, 5, 2)])
def test_features_equal_a_scan_for_every_anchor(spark, seed, step, lookback, horizon):
    rows, last = _events(seed), BASE + dt.timedelta(days=21)
    got = PR.build_features(events_df(spark, rows), str(BASE), str(last), step, lookback, horizon).collect()
    want, day = {}, BASE
    while day <= last:
        want |= {(day, u): f for u, f in _by_hand(rows, day, lookback, horizon).items()}
        day += dt.timedelta(days=step)
    assert {(r.anchor_date, r.user_pseudo_id): tuple(r)[2:] for r in got} == want
    assert len(got) == len(want)


def _shuffled(df):
    """Rows written to shuffles by the executed plan of ``df``."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if kind == "ShuffleExchangeExec":
            total += p.metrics().apply("shuffleRecordsWritten").value()
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


def test_shuffled_rows_do_not_depend_on_the_number_of_anchors(spark):
    events = read_events(spark, "/root/testdata/sf0.01")
    few, many = (PR.build_features(events, "2024-01-04", "2024-01-28", step) for step in (8, 1))
    rows = few.count(), many.count()
    shuffled = _shuffled(few), _shuffled(many)
    assert rows[1] > 5 * rows[0]
    assert shuffled[0] > 0 and shuffled[1] < 1.6 * shuffled[0]       # changes sum up at fewer places with fewer anchors
    assert len(PR.build_features(events, "2024-01-04", "2024-01-28", 1)._jdf.queryExecution().optimizedPlan().collectLeaves().toList().toString().split("Relation")) == 2


def test_one_user_with_most_of_the_events(spark):
    rows = [ev(i, "hot" if i % 10 else f"u{i}", f"2024-02-{1 + i % 28:02d} {i % 24:02d}:00:00", "page_view", i,
               page_location=f"https://s/cruises/it{i % 3}") for i in range(3000)]
    got = {r.user_pseudo_id: r for r in PR.build_features(events_df(spark, rows), "2024-02-20", "2024-02-20", 1).collect()}
    hot = [r for r in rows if r["user_pseudo_id"] == "hot" and r["event_ts"].day < 20]
    assert got["hot"].visits_30d == len(hot) == got["hot"].itinerary_page_visits_30d and got["hot"].multi_itinerary_interest == 1
