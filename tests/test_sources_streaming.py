import os
import shutil
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.sources import ga4
from wayfare.streaming.events import start_conversion_sink

SF = "/root/testdata/sf0.001"


def test_ga4_export_shard_scan_and_flatten(spark):
    params = T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StructType([T.StructField("string_value", T.StringType()),
                                             T.StructField("int_value", T.LongType())]))]))
    schema = T.StructType([T.StructField("user_pseudo_id", T.StringType()),
                           T.StructField("event_timestamp", T.LongType()),
                           T.StructField("event_date", T.StringType()),
                           T.StructField("event_name", T.StringType()),
                           T.StructField("event_params", params),
                           T.StructField("shard", T.StringType())])
    rows = [("u", 1_704_067_200_000_000, "20240101", "generate_lead", [("lead_name", ("booking", None))], "20240101"),
            ("u", 1_704_153_600_000_000, "20240101", "page_view", [("ga_session_id", (None, 5))], "20240102"),
            ("u", 1_704_240_000_000_000, "20240103", "page_view", [], "20240103")]
    d = tempfile.mkdtemp(prefix="wayfare-ga4-")
    spark.createDataFrame(rows, schema).write.partitionBy("shard").mode("overwrite").parquet(d)
    flat = ga4.read_export(spark, d, start="20240101", end="20240102")
    got = sorted((r.event_name, r.lead_name, r.ga_session_id) for r in flat.collect())
    assert got == [("generate_lead", "booking", None), ("page_view", None, 5)]
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "shard" in plan


def test_streaming_conversions_available_now(spark):
    src = tempfile.mkdtemp(prefix="wayfare-src-")
    shutil.copy(os.path.join(SF, "events.parquet"), os.path.join(src, "part-0.parquet"))
    sink = tempfile.mkdtemp(prefix="wayfare-sink-")
    ckpt = tempfile.mkdtemp(prefix="wayfare-ckpt-")
    q = start_conversion_sink(spark, src, sink, ckpt)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    from wayfare.operators.sessions import conversions
    from wayfare.sources.driver import read_events
    batch = conversions(read_events(spark, SF), total_label=None)
    assert out.count() == batch.count() > 0
    assert out.select("action_type").distinct().count() == 2


def test_materialised_tables(spark):
    from wayfare.plans.materialize import run
    out = tempfile.mkdtemp(prefix="wayfare-wh-")
    paths = run(spark, "/root/testdata/sf0.01", out)
    preds = spark.read.parquet(paths["predictions"])
    assert preds.count() == spark.read.parquet(paths["scoring"]).count()
    assert preds.filter((F.col("propensity_score") < 0) | (F.col("propensity_score") > 1)).count() == 0
    assert spark.read.parquet(paths["importance"]).count() == 23


def test_crm_tables_conform_to_declared_schemas(spark):
    from wayfare.sources import crm
    from wayfare.sources import driver as D
    ev = D.read_events(spark, SF)
    built = {
        "booking_role": D.booking_role(spark, SF), "booking_header": D.booking_header(spark, SF),
        "web_request": D.web_request(spark, SF), "super_id": D.super_ids(spark, SF),
        "super_id_latest_individual_id": D.latest_individual(spark, SF),
        "visitor_segments": D.visitor_segments(ev), "visit_leads": D.visit_leads(ev),
        "visits": D.curated_visits(ev),
    }
    for name, df in built.items():
        assert crm.conforms(df, name), (name, df.schema.simpleString())
    out = tempfile.mkdtemp(prefix="wayfare-crm-")
    built["booking_header"].write.mode("overwrite").parquet(out)
    assert crm.read_table(spark, out, "booking_header").count() == built["booking_header"].count()


def test_flat_event_table_stream_and_partition_pruning(spark):
    from wayfare.operators import sessions as S
    from wayfare.sources import driver as D
    from wayfare.sources.tables import read_flat_events
    from wayfare.streaming.events import start_flat_event_sink
    src = tempfile.mkdtemp(prefix="wayfare-src-")
    shutil.copy(os.path.join(SF, "events.parquet"), os.path.join(src, "part-0.parquet"))
    sink, ckpt = tempfile.mkdtemp(prefix="wayfare-flat-"), tempfile.mkdtemp(prefix="wayfare-ckpt-")
    start_flat_event_sink(spark, src, sink, ckpt).awaitTermination(120)
    flat = read_flat_events(spark, sink)
    direct = D.read_events(spark, SF)
    assert dict(flat.dtypes)["event_date"] == "string"

    def summary(ev):
        per = S.sessions_before_conversion(S.conversions(ev), S.sessions(ev))
        return sorted(tuple(r) for r in S.summarize_sessions_before(per).collect())
    assert summary(flat) == summary(direct)
    part = read_flat_events(spark, sink, period=("20240110", "20240112"))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_date" in plan
    assert part.count() == direct.filter(F.col("event_date").between("20240110", "20240112")).count()
