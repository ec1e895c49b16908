from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.functions import buckets as B
from wayfare.functions import vocab as V
from wayfare.functions.dates import calendar_days, elapsed_days, parse_multi_date
from wayfare.functions.params import flatten_events, param
from wayfare.functions.text import regex_extract_or_null

PARAMS = T.ArrayType(T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StructType([T.StructField("string_value", T.StringType()),
                                         T.StructField("int_value", T.LongType())]))]))


def test_param_missing_key_is_null(spark):
    schema = T.StructType([T.StructField("user_pseudo_id", T.StringType()),
                           T.StructField("event_params", PARAMS)])
    df = spark.createDataFrame([("u1", [("lead_name", ("booking", None)), ("ga_session_id", (None, 7))]),
                                ("u2", [])], schema)
    out = {r.user_pseudo_id: r for r in flatten_events(
        df, {"lead": ("lead_name", "string"), "sid": ("ga_session_id", "int"),
             "pay": ("payment_type", "string")}, keep=("user_pseudo_id",)).collect()}
    assert out["u1"].lead == "booking" and out["u1"].sid == 7 and out["u1"].pay is None
    assert out["u2"].lead is None and out["u2"].sid is None
    r = df.select(param("ga_session_id", "int").alias("x")).collect()
    assert [x.x for x in r] == [7, None]


def test_parse_multi_date(spark):
    df = spark.createDataFrame([("2026-04-02",), ("02-04-2026",), ("n/a",), (None,)], "s string")
    got = [r.d for r in df.select(parse_multi_date(F.col("s"), V.DEPARTURE_FORMATS).alias("d")).collect()]
    import datetime as dt
    assert got == [dt.date(2026, 4, 2), dt.date(2026, 4, 2), None, None]


def test_elapsed_vs_calendar_days(spark):
    # 23 h over midnight: 0 elapsed days, 1 calendar day; 24 h: 1 and 1
    rows = [(1_000_000 * 3600 * 2, 1_000_000 * 3600 * 25), (0, 1_000_000 * 3600 * 24)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select(elapsed_days("b", "a").alias("e"),
                    calendar_days(F.to_date(F.timestamp_micros("b")), F.to_date(F.timestamp_micros("a"))).alias("c")) \
        .collect()
    assert [(r.e, r.c) for r in got] == [(0, 1), (1, 1)]


def test_regex_no_match_is_null(spark):
    df = spark.createDataFrame([("x?IndividualId=123&y",), ("x?IndividualId=abc",)], "u string")
    got = [r.i for r in df.select(regex_extract_or_null(F.col("u"), V.INDIVIDUAL_ID_REGEX).alias("i")).collect()]
    assert got == ["123", None]


def test_vs_wildcard_and_literal(spark):
    df = spark.createDataFrame([("a?utm_medium=EMAIL&c=x_VS_1",), ("a?utm_medium=email&c=xaVSb",),
                                ("a?utm_medium=cpc&c=x_VS_1",)], "raw_url string")
    loose = [r.v for r in df.select(V.is_vs().alias("v")).collect()]
    strict = [r.v for r in df.select(V.is_vs(literal=True).alias("v")).collect()]
    assert loose == [True, True, False]
    assert strict == [True, False, False]


def test_purchase_variants_null_semantics(spark):
    rows = [Row(event_name="purchase", p_journey_is_destex="NO", payment_type=None),
            Row(event_name="purchase", p_journey_is_destex=None, payment_type="free"),
            Row(event_name="purchase", p_journey_is_destex="NO", payment_type="total")]
    df = spark.createDataFrame(rows, "event_name string, p_journey_is_destex string, payment_type string")

    def kept(v):
        return df.filter(V.purchase(v)).count()
    assert kept("A") == 0       # NULL payment or NULL destex drops
    assert kept("B") == 0       # NULL payment drops
    assert kept("C") == 1       # coalesce keeps the NULL payment row


def test_page_group_funnel_first(spark):
    vb = V.DEFAULT_VOCAB
    df = spark.createDataFrame([(f"https://{vb.funnel_host}/journeys/x",), ("https://s/en/journeys/a",),
                                ("https://s/en/my-area/journeys/",), ("https://s/home",)], "page_location string")
    got = [r.g for r in df.select(V.page_group().alias("g")).collect()]
    assert got == ["Funnel", "Itinerary Page", None, None]


def test_bucketize_first_rule_wins(spark):
    df = spark.createDataFrame([(-3,), (0,), (5,), (400,), (None,)], "d int")
    got = [r.b for r in df.select(B.bucketize(F.col("d"), B.DEPARTURE_BANDS, B.DEPARTURE_ELSE).alias("b")).collect()]
    assert got[:4] == ["0 - Dopo la partenza", "1 - Giorno di partenza", "2 - 1-7 giorni", "7 - 365+ giorni"]


def test_not_in_with_null_vs_anti_join(spark):
    """Why exclusion is always a left_anti join: NOT IN with one NULL key drops everything."""
    users = spark.createDataFrame([("a",), ("b",)], "u string")
    bad = spark.createDataFrame([("a",), (None,)], "u string")
    users.createOrReplaceTempView("t_users")
    bad.createOrReplaceTempView("t_bad")
    assert spark.sql("SELECT u FROM t_users WHERE u NOT IN (SELECT u FROM t_bad)").count() == 0
    assert [r.u for r in users.join(bad, "u", "left_anti").collect()] == ["b"]


def test_median_approx_switch(spark):
    from wayfare.functions.stats import median_cont, median_disc
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    r = df.agg(median_disc("x").alias("d"), median_disc("x", approx=True).alias("a"),
               median_cont("x").alias("c")).collect()[0]
    assert r.d == 5.0 and r.a == 5.0 and r.c == 5.5
