from tests.helpers import events_df, ev
from wayfare.functions import vocab as V
from wayfare.operators import departure as DP
from wayfare.operators import funnel as FU
from wayfare.operators import paths as PA

SS = "https://www.cruise-line.test/en/booking?step=suites&journey=J1"


def test_page_path_distinct_truncation_and_depth(spark):
    rows, eid = [], 0
    # 12 earlier sessions with one page each, then a conversion session
    for d in range(1, 13):
        eid += 1
        rows.append(ev(eid, "a", f"2024-01-{d:02d} 10:00:00", "page_view", d, page_location=f"/p{d}"))
    rows += [
        ev(100, "a", "2024-01-20 10:00:00", "page_view", 20, page_location="/same"),
        ev(101, "a", "2024-01-20 10:01:00", "page_view", 20, page_location="/same"),
        ev(102, "a", "2024-01-20 10:02:00", "generate_lead", 20, lead_name="booking"),
        ev(103, "a", "2024-01-20 10:03:00", "page_view", 20, page_location="/after"),
    ]
    out = {r.page_url: r for r in PA.page_path_backward(events_df(spark, rows), depth=10).collect()}
    assert out["/same"].session_minus_0 == 1 and out["/same"].total_appearances == 1
    assert "/after" not in out                                   # after the conversion, position 0
    assert out["/p12"].session_minus_1 == 1 and out["/p3"].session_minus_10 == 1
    assert "/p2" not in out and "/p1" not in out                 # beyond depth 10


def test_suite_funnel_edges(spark):
    rows = [
        # u1: personal area before the start step in the same session -> excluded
        ev(1, "u1", "2024-01-01 10:00:00", "page_view", 1, page_location="https://x/en/my-area/"),
        ev(2, "u1", "2024-01-01 10:01:00", "page_view", 1, page_location=SS),
        # u2: personal area after the start -> kept; start without journey code; 12 touchpoints
        ev(3, "u2", "2024-01-01 10:00:00", "page_view", 1, page_location=SS),
        *[ev(10 + i, "u2", f"2024-01-01 10:{i + 1:02d}:00", "page_view", 1, page_location=f"/t{i}")
          for i in range(11)],
        ev(30, "u2", "2024-01-01 10:30:00", "begin_checkout", 1, p_journey_code="J9"),
        ev(31, "u2", "2024-01-01 10:31:00", "request_quote_confirmation", 1),
        # u3: start with code J1, re-entry with J2, strict hold
        ev(40, "u3", "2024-01-01 09:00:00", "page_view", 5, page_location=SS, p_journey_code="J1"),
        ev(41, "u3", "2024-01-01 09:01:00", "begin_checkout", 5, p_journey_code="J2"),
        ev(42, "u3", "2024-01-01 09:02:00", "generate_lead", 5, lead_name="booking", payment_type="free",
           booking_status="option"),
    ]
    out = {r.user_pseudo_id: r for r in FU.suite_funnel(events_df(spark, rows)).collect()}
    assert "u1" not in out
    u2 = out["u2"]
    assert u2.pv_1 == "/t0" and u2.pv_10 == "/t9"              # pv_10 cut
    assert u2.flag_raq == 1 and u2.flag_reingresso_viaggio_diverso == 0   # NULL start code -> 0
    u3 = out["u3"]
    assert u3.flag_reingresso_viaggio_diverso == 1 and u3.flag_bh == 1 and u3.pv_1 == "BH"
    assert u3.pv_2 is None


def test_journey_pages_refresh_dedup(spark):
    rows = [ev(i, "a", f"2024-01-01 10:0{i}:00", "page_view", 1, page_location=p)
            for i, p in enumerate(["/a", "/a", "/b", "/a", "/a"])]
    rows.append(ev(9, "a", "2024-01-01 10:09:00", "generate_lead_WEBQ", 1))
    r = PA.journey_pages(events_df(spark, rows)).collect()[0]
    assert (r.page_1, r.page_2, r.page_3, r.page_4) == ("/a", "/b", "/a", None)
    assert r.has_WEBQ == 1 and r.has_FE == 0


def test_departure_inheritance(spark):
    fun = f"https://{V.DEFAULT_VOCAB.funnel_host}/journeys/x"
    itin = "https://s/en/journeys/d"
    rows = [
        ev(1, "a", "2024-01-01 10:00:00", "page_view", 1, page_location=itin, p_sub_category="car",
           p_departure_date="2024-02-01"),
        ev(2, "a", "2024-01-01 10:05:00", "page_view", 1, page_location=fun, p_departure_date="01-02-2024"),
        ev(3, "a", "2024-01-02 10:00:00", "page_view", 2, page_location=itin, p_sub_category="med",
           p_departure_date="n/a"),
        ev(4, "a", "2024-01-03 10:00:00", "page_view", 3, page_location=fun, p_departure_date="2024-02-01"),
        ev(5, "b", "2024-01-03 10:00:00", "page_view", 3, page_location=fun, p_departure_date="2024-02-01"),
    ]
    c = DP.with_destination(DP.classified_views(events_df(spark, rows)))
    got = {r.event_id: r.final_sub_category for r in c.collect()}
    assert got[2] == "car"        # session wins
    assert got[4] == "med"        # user fallback: last itinerary page overall
    assert got[5] is None         # nothing to inherit
    assert 3 not in got           # unparsable departure dropped
