"""Adapter from the driver's test tables to the flat event view and CRM tables.

The driver ships a generic ``events`` table (event_id, ts, user_id,
event_type, value, props JSON ``{"k": 0..99}``) plus TPC-H style
``customer`` and ``orders``.  This module maps them, deterministically and
row by row, onto the shapes the analyses read:

* flat event view (one typed column per GA4 parameter, see
  ``FLAT_COLUMNS``),
* identity graph (``super_id`` with ``google_ids`` array,
  ``super_id_latest_individual_id``),
* bookings (``booking_role``, ``booking_header``) and ``web_request``,
* curated ``visitor_segments`` / ``visit_leads`` / ``visits``.

Every mapping is a projection (narrow, codegen'd, column-pruned at the
scan); the only shuffle here is ``curated_visits``, an aggregation by
(visitor, session).  The DuckDB twin of each mapping lives in
``wayfare.plans.oracle`` and must stay expression-for-expression equal.

Mapping of the event stream (k = props.k, j = event_id mod 100,
u = (k + j) mod 100):

* event_name: view -> page_view; click -> content_cta (k<16), begin_checkout
  (<24), request_call_back (<32), request_quote (<40), request_brochure
  (<48), find_your_cruise_filter (<60), else page_view; signup ->
  generate_lead (k<40), _WEBQ (<55), _WBOF_01 (<65), _WBOF_04 (<70), _RAB
  (<75), _RAQ (<80), _SFO (<85), _WBBK (<92), else _WBCH; purchase ->
  purchase; error -> experiment_viewed.
* page_location by u: suite-selection step, itinerary pages, booking
  funnel, personal area, about, cruise pages, destination pages, quote
  pages, email links with and without the campaign tag, home, NULL.
* raw_url = page_location, NULL when event_id mod 13 = 0.
* ga_session_id = yyyyMMdd (user x day), NULL when event_id mod 97 = 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import vocab as V
from wayfare.functions.params import DEFAULT_SPEC
from wayfare.functions.dates import micros_of_ntz
from wayfare.session import sf_path

FLAT_COLUMNS = [
    "event_id", "user_pseudo_id", "event_ts", "event_timestamp", "event_date",
    "event_name", "ga_session_id", "page_location", "raw_url", "lead_name",
    "payment_type", "booking_status", "p_journey_is_destex", "p_journey_code",
    "p_departure_date", "p_sub_category", "experiment_id", "variation_id",
    "cta_name", "cta_type", "voyage_funnel_step_name", "uwrid", "market",
    "ab_component_tests", "event_value_in_usd",
]

# Fixed values of the adapter (placeholder hosts match wayfare.functions.vocab.Vocab).
SITE = "https://www.cruise-line.test"
FUNNEL = "https://booking.cruise-line.test/touchb2c"
QUOTE = "https://quote.cruise-line.test"
MARKETS = ["US", "UK", "LACAR", "DE", "IT", "AU"]
STEP_NAMES = ["guests", "category", "fare", "summary"]


def _pick(values: list[str], idx: Column) -> Column:
    # try_element_at: an index past the list gives NULL (a missing parameter)
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _s(c: Column) -> Column:
    return c.cast("string")


_ADAPTER_CACHE: dict[str, list[Column]] = {}


def flat_events_from_driver(raw: DataFrame) -> DataFrame:
    """Driver ``events`` -> flat GA4-style event view (pure projection)."""
    if not _ADAPTER_CACHE:
        # unresolved expressions are reusable: build the trees once per process
        _ADAPTER_CACHE.update(_adapter_columns())
    c = _ADAPTER_CACHE
    return raw.select(*c["stage1"]).select(*c["stage2"]).select(*c["stage3"])


def _adapter_columns() -> dict[str, list[Column]]:
    # a props text that is no JSON, or whose k is no number, gives NULL
    k = F.get_json_object("props", "$.k").try_cast("int")
    stage1 = [F.col(c) for c in ("event_id", "ts", "user_id", "event_type", "value")] + [
        k.alias("_k"), F.pmod("event_id", F.lit(100)).cast("int").alias("_j")]
    stage2 = [F.col("*"), F.pmod(F.col("_k") + F.col("_j"), F.lit(100)).alias("_u")]
    k, j, u, et, uid = F.col("_k"), F.col("_j"), F.col("_u"), F.col("event_type"), F.col("user_id")

    click_name = (F.when(k < 16, F.lit(V.CONTENT_CTA)).when(k < 24, F.lit(V.BEGIN_CHECKOUT))
                  .when(k < 32, F.lit(V.REQUEST_CALL_BACK)).when(k < 40, F.lit(V.REQUEST_QUOTE))
                  .when(k < 48, F.lit(V.REQUEST_BROCHURE)).when(k < 60, F.lit(V.FYC_FILTER))
                  .otherwise(F.lit(V.PAGE_VIEW)))
    lead_name = (F.when(k < 40, F.lit(V.GENERATE_LEAD)).when(k < 55, F.lit(V.LEAD_WEBQ))
                 .when(k < 65, F.lit(V.LEAD_WBOF_01)).when(k < 70, F.lit(V.LEAD_WBOF_04))
                 .when(k < 75, F.lit(V.LEAD_RAB)).when(k < 80, F.lit(V.LEAD_RAQ))
                 .when(k < 85, F.lit(V.LEAD_SFO)).when(k < 92, F.lit(V.LEAD_WBBK))
                 .otherwise(F.lit(V.LEAD_WBCH)))
    event_name = (F.when(et == "view", F.lit(V.PAGE_VIEW)).when(et == "click", click_name)
                  .when(et == "signup", lead_name).when(et == "purchase", F.lit(V.PURCHASE))
                  .when(et == "error", F.lit(V.EXPERIMENT_VIEWED)))

    ind_id = _s(uid * 10 + F.pmod(j, F.lit(10)))
    page = (
        F.when(u < 8, F.concat(F.lit(SITE + "/en/booking?step=suites&journey=J"), _s(F.pmod(j, F.lit(6)))))
        .when(u < 22, F.concat(F.lit(SITE + "/en/journeys/dest-"), _s(F.pmod(j, F.lit(5))),
                               F.lit("/voyage-"), _s(F.pmod(j, F.lit(7)))))
        .when(u < 34, F.concat(F.lit(FUNNEL + "/journeys/step-"), _s(F.pmod(j, F.lit(4)))))
        .when(u < 38, F.concat(F.lit(SITE + "/en/my-area/journeys/"), _s(F.pmod(j, F.lit(3)))))
        .when(u < 41, F.lit(SITE + "/en/about/journeys"))
        .when(u < 52, F.concat(F.lit(SITE + "/cruises/itin-"), _s(F.pmod(j, F.lit(9))),
                               F.lit("?ref="), _s(F.pmod(j, F.lit(2)))))
        .when(u < 62, F.concat(F.lit(SITE + "/destinations/dest-"), _s(F.pmod(j, F.lit(6))),
                               F.lit("/overview")))
        .when(u < 70, F.concat(F.lit(QUOTE + "/voyage/"), _s(F.pmod(j, F.lit(4))),
                               F.when(F.pmod(j, F.lit(3)) == 0, F.lit("/guests-info"))
                               .otherwise(F.lit("/summary"))))
        .when(u < 80, F.concat(F.lit(SITE + "/offers?utm_medium=Email&utm_campaign="),
                               F.when(F.pmod(j, F.lit(2)) == 0, F.lit("spring_VS_")).otherwise(F.lit("springXVSY")),
                               _s(F.pmod(j, F.lit(5))), F.lit("&IndividualId="), ind_id))
        .when(u < 90, F.concat(F.lit(SITE + "/lp?utm_medium=email&utm_campaign=news"),
                               _s(F.pmod(j, F.lit(5))), F.lit("&IndividualId="),
                               F.when(F.pmod(j, F.lit(17)) == 0, F.lit("unknown")).otherwise(ind_id)))
        .when(u < 96, F.lit(SITE + "/home"))
    )
    day = F.to_date("ts")
    departure = (
        F.when(k < 45, F.date_format(F.date_add(day, k * 10 - 5), "yyyy-MM-dd"))
        .when(k < 75, F.date_format(F.date_add(day, k * 3 - 150), "dd-MM-yyyy"))
        .when(k < 80, F.lit("n/a"))
    )
    is_exp = et == "error"
    is_webq = (et == "signup") & (k >= 40) & (k < 55)
    is_click = et == "click"
    variation = (F.when(~is_exp, F.lit(None).cast("string"))
                 .when(F.pmod(k, F.lit(25)) == 24, F.lit(None).cast("string"))
                 .when((F.pmod(uid, F.lit(2)) == 0) | ((F.pmod(uid, F.lit(3)) == 0) & (F.pmod(k, F.lit(10)) == 7)),
                       F.lit("a"))
                 .otherwise(F.lit("b")))

    stage3 = [
        F.col("event_id"),
        _s(uid).alias("user_pseudo_id"),
        F.col("ts").alias("event_ts"),
        micros_of_ntz("ts").alias("event_timestamp"),
        F.date_format("ts", "yyyyMMdd").alias("event_date"),
        event_name.alias("event_name"),
        F.when(F.pmod(F.col("event_id"), F.lit(97)) == 0, F.lit(None).cast("long"))
         .otherwise(F.date_format("ts", "yyyyMMdd").cast("long")).alias("ga_session_id"),
        page.alias("page_location"),
        F.when(F.pmod(F.col("event_id"), F.lit(13)) != 0, page).alias("raw_url"),
        F.when((et == "signup") & (k < 40),
               F.when(F.pmod(k, F.lit(2)) == 0, F.lit(V.LEAD_NAME_BOOKING)).otherwise(F.lit("newsletter")))
         .alias("lead_name"),
        _pick(["total", "free", "deposit"], F.pmod(j, F.lit(4))).alias("payment_type"),
        F.when(F.pmod(j, F.lit(3)) == 0, F.lit("confirmed")).otherwise(F.lit(V.BOOKING_STATUS_OPTION))
         .alias("booking_status"),
        F.when(F.pmod(k, F.lit(10)) == 0, F.lit(V.DESTEX_YES))
         .when(F.pmod(k, F.lit(10)) == 1, F.lit(None).cast("string"))
         .otherwise(F.lit(V.DESTEX_NO)).alias("p_journey_is_destex"),
        F.when(F.pmod(j, F.lit(20)) == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("J"), _s(F.pmod(j, F.lit(6))))).alias("p_journey_code"),
        departure.alias("p_departure_date"),
        F.when((u >= 8) & (u < 22) & (F.pmod(j, F.lit(4)) != 0),
               F.concat(F.lit("dest-"), _s(F.pmod(j, F.lit(5))))).alias("p_sub_category"),
        F.when(is_exp, F.when(k < 60, F.lit("exp_popup")).otherwise(F.lit("exp_other"))).alias("experiment_id"),
        variation.alias("variation_id"),
        F.when(is_click & (k < 8), F.lit(V.CTA_POPUP))
         .when(is_click & (k < 16), F.lit(V.CTA_RETURN_TO_FUNNEL)).alias("cta_name"),
        F.when(is_click & (k < 8), F.lit(V.CTA_POPUP_SEEN))
         .when(is_click & (k < 16), F.lit("cta_click")).alias("cta_type"),
        F.when(is_webq, F.concat(_pick(STEP_NAMES, F.pmod(k, F.lit(4))), F.lit(" WEBQ")))
         .when((u >= 62) & (u < 70), _pick(STEP_NAMES, F.pmod(j, F.lit(4)))).alias("voyage_funnel_step_name"),
        F.when(is_webq, F.concat(F.lit("U"), _s(F.col("event_id")))).alias("uwrid"),
        F.when(F.pmod(j, F.lit(7)) == 6, F.lit(None).cast("string"))
         .otherwise(_pick(MARKETS, F.pmod(j, F.lit(6)))).alias("market"),
        F.when(is_exp & (k >= 60),
               F.when(F.pmod(j, F.lit(3)) == 0, F.lit('{"test":"payment-loading-progress","s":"b"}'))
                .when(F.pmod(j, F.lit(3)) == 1, F.lit('{"test":"payment-loading-progress","segmentId":"b"}'))
                .otherwise(F.lit('{"test":"payment-loading-progress","s":"a"}'))).alias("ab_component_tests"),
        F.col("value").alias("event_value_in_usd"),
    ]
    return {"stage1": stage1, "stage2": stage2, "stage3": stage3}


def nested_export(flat: DataFrame) -> DataFrame:
    """The flat view as a GA4-style export: parameters as ``event_params`` (absent ones
    left out), date shards, every 50th event arriving in the next day's shard."""
    none = {f"{kind}_value": F.lit(None).cast(t) for kind, t in (("string", "string"), ("int", "long"), ("float", "double"),
                                                                 ("double", "double"))}

    def entry(column: str, key: str, kind: str) -> Column:
        value = {**none, f"{kind}_value": F.col(column)}
        return F.when(F.col(column).isNotNull(),
                      F.struct(F.lit(key).alias("key"), F.struct(*[c.alias(k) for k, c in value.items()]).alias("value")))

    day = F.to_date("event_date", "yyyyMMdd")
    late = F.pmod(F.col("event_id"), F.lit(50)) == 0
    return flat.select(
        "user_pseudo_id", "event_timestamp", "event_date", "event_name", "event_value_in_usd",
        F.date_format(F.when(late, F.date_add(day, 1)).otherwise(day), "yyyyMMdd").alias("shard"),
        F.filter(F.array(*[entry(c, key, kind) for c, (key, kind) in DEFAULT_SPEC.items()]), lambda p: p.isNotNull()).alias("event_params"))


def read_events(spark: SparkSession, sf_dir: str, period: tuple[str, str] | None = None,
                since: str | None = None) -> DataFrame:
    """Flat event view; ``period`` (inclusive yyyyMMdd bounds) or ``since`` are
    applied to the raw timestamp so the Parquet reader receives them as pushed
    filters (row-group skipping) — a filter on the derived ``event_date``
    string could not be pushed through the projection."""
    raw = spark.read.parquet(sf_path(sf_dir, "events"))
    lo = period[0] if period else since
    if lo:
        raw = raw.filter(F.col("ts") >= F.to_timestamp_ntz(F.lit(lo), F.lit("yyyyMMdd")))
    if period:
        raw = raw.filter(F.col("ts") < F.date_add(F.to_date(F.lit(period[1]), "yyyyMMdd"), 1)
                         .cast("timestamp_ntz"))
    return flat_events_from_driver(raw)


# --------------------------------------------------------------------------
# CRM / identity tables derived from customer and orders
# --------------------------------------------------------------------------

def super_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity clusters: super_id -> google_ids (cookie ids).

    Every 7th cluster also claims the next customer's cookie (a cookie in two
    clusters fans out), every 11th (mod 11 = 5) has an empty array.
    """
    c = spark.read.parquet(sf_path(sf_dir, "customer")).select("c_custkey")
    key = F.col("c_custkey")
    ids = (F.when(F.pmod(key, F.lit(11)) == 5, F.array().cast("array<string>"))
           .when(F.pmod(key, F.lit(7)) == 0, F.array(_s(key), _s(key + 1)))
           .otherwise(F.array(_s(key))))
    return c.select(F.concat(F.lit("S"), _s(key)).alias("super_id"), ids.alias("google_ids"))


def latest_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """super_id -> latest_individual_id.  Coverage gap: customers with a negative
    account balance have no individual record (the chain breaks there)."""
    c = spark.read.parquet(sf_path(sf_dir, "customer")).select("c_custkey", "c_acctbal")
    return (c.filter(F.col("c_acctbal") >= 0)
            .select(F.concat(F.lit("S"), _s(F.col("c_custkey"))).alias("super_id"),
                    F.col("c_custkey").alias("latest_individual_id")))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(sf_path(sf_dir, "orders"))


def booking_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return o.select(F.col("o_custkey").alias("IndividualId"),
                    F.concat(F.lit("B"), _s(F.col("o_orderkey"))).alias("BkgCod"))


def booking_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order status F -> 'BK' (booked), O -> 'OP', P -> 'CX'; dates shifted +23 years."""
    o = _orders(spark, sf_dir)
    return o.select(
        F.concat(F.lit("B"), _s(F.col("o_orderkey"))).alias("BkgCod"),
        F.when(F.col("o_orderstatus") == "F", F.lit("BK"))
         .when(F.col("o_orderstatus") == "O", F.lit("OP")).otherwise(F.lit("CX")).alias("BkgStatus"),
        F.add_months(F.col("o_orderdate"), 276).alias("ConfirmationDate"),
    )


def web_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return o.select(
        F.col("o_custkey").alias("IndividualId"),
        F.concat(F.lit("U"), _s(F.col("o_orderkey") * 5)).alias("uwrid"),
        F.add_months(F.col("o_orderdate"), 276).alias("Date"),
        F.col("o_orderpriority").alias("RequestTypology"),
    )


# --------------------------------------------------------------------------
# Curated tables derived from the event view
# --------------------------------------------------------------------------

def visitor_segments(events: DataFrame) -> DataFrame:
    """(visitor, day) with segment / market / device / channel attributes."""
    j = F.pmod(F.col("event_id"), F.lit(100))
    return events.select(
        F.col("user_pseudo_id").alias("visitor_id"),
        F.to_date("event_ts").alias("date"),
        F.concat(F.lit("seg_"), _pick(["A", "B", "C"], F.pmod(j, F.lit(3)))).alias("segment"),
        F.col("market"),
        _pick(["desktop", "mobile"], F.pmod(F.col("event_id"), F.lit(2))).alias("device_category"),
        _pick(["organic", "paid", "email", "direct"], F.pmod(F.col("event_id"), F.lit(4))).alias("visit_channel"),
    )


LEAD_TYPES = {  # event name -> web request type (fixed values)
    "generate_lead_WEBQ": "WEBQ", "generate_lead_WBBK": "WBBK", "generate_lead_WBOF_01": "WBOF.01",
    "generate_lead_WBOF_04": "WBOF.04", "generate_lead_RAQ": "RAQ", "generate_lead_RAB": "RAB",
    "generate_lead_SFO": "SFO", "generate_lead_WBCH": "WBCH",
}


def visit_leads(events: DataFrame) -> DataFrame:
    """Lead events with type, source, booking status and an integer revenue.

    Revenue is whole currency units (value * 100 rounded down) so that sums
    are exact in every engine.
    """
    m = F.create_map(*[x for kv in LEAD_TYPES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    j = F.pmod(F.col("event_id"), F.lit(100))
    ev = events.filter(F.col("event_name").isin(list(LEAD_TYPES)))
    return ev.select(
        F.col("user_pseudo_id").alias("visitor_id"),
        m[F.col("event_name")].alias("web_request_type"),
        _pick(["ECommerce", "PriceConfig"], F.pmod(j, F.lit(3))).alias("webq_source"),
        F.col("event_ts").alias("event_timestamp"),
        F.when(F.pmod(j, F.lit(11)) == 0, F.lit(0.0))
         .otherwise(F.floor(F.col("event_value_in_usd") * 100).cast("double")).alias("net_cruise_revenue"),
        F.when(F.pmod(j, F.lit(5)) == 0, F.lit("OP")).otherwise(F.lit("BK")).alias("booking_status"),
    )


def curated_visits(events: DataFrame) -> DataFrame:
    """One row per (visitor, session): start, bounce flag, page views, interactions."""
    return (events.filter(F.col("ga_session_id").isNotNull())
            .groupBy(F.col("user_pseudo_id").alias("visitor_id"), "ga_session_id")
            .agg(F.min("event_ts").alias("visit_start_timestamp"),
                 (F.count(F.lit(1)) == 1).alias("is_bounce"),
                 F.count_if(F.col("event_name") == V.PAGE_VIEW).alias("pageview_count"),
                 F.count_if(F.col("event_name") != V.PAGE_VIEW).alias("content_interaction_count"))
            .select("visitor_id", F.concat("visitor_id", F.lit("-"), _s(F.col("ga_session_id"))).alias("visit_id"),
                    "visit_start_timestamp", "is_bounce", "pageview_count", "content_interaction_count"))
