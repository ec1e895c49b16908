"""The reset-window queries on a copy of the driver's events with repeated timestamps."""
import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"
KEYS = ["sessions_before_conversion", "sessions_before_hist", "days_before_conversion", "first_visit_to_action",
        "page_path_backward", "page_path_backward_hold", "page_path_backward_purchase", "suite_funnel", "journey_pages",
        "propensity_features"]


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Every third event once more at its own timestamp under a new id."""
    out = tmp_path_factory.mktemp("tied")
    events = spark.read.parquet(f"{SF}/events.parquet")
    again = events.filter("event_id % 3 = 0").selectExpr(
        *[("event_id + 1000003 AS event_id" if c == "event_id" else c) for c in events.columns])
    events.unionByName(again).coalesce(1).write.parquet(f"{out}/events.parquet")
    return str(out)


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
@pytest.mark.parametrize("key", KEYS)
def test_queries_match_their_oracles_on_ties(spark, tied, key):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tied}/events.parquet/*.parquet')")
    assert rows_of(E.queries()[key](spark, tied).toPandas()) == rows_of(con.execute(E.oracle_sql()[key]).df())
