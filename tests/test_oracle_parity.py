"""Every registered query equals its DuckDB oracle on the smallest driver tables."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    sp = E.queries()[key](spark, SF).toPandas()
    dp = con.execute(E.oracle_sql()[key]).df()
    sc, sr = rows_of(sp)
    dc, dr = rows_of(dp)
    assert sc == dc
    assert sr == dr


def test_every_query_has_oracle_or_is_ml():
    rows_only = {k for k in set(E.queries()) - set(E.oracle_sql()) if not (k == "pipeline" or k.startswith("op"))}
    assert rows_only <= {"propensity_train_predict", "propensity_evaluate", "propensity_importance"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "avg_sessions_before" in df.columns


TZ_SENSITIVE = ["suite_funnel", "source_date_ranges", "propensity_features", "days_before_conversion",
                "visits_rollup", "component_variant"]


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
def test_results_do_not_depend_on_the_session_time_zone(spark, con):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        for key in TZ_SENSITIVE:
            sp = E.queries()[key](spark, SF).toPandas()
            assert rows_of(sp) == rows_of(con.execute(E.oracle_sql()[key]).df()), key
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
