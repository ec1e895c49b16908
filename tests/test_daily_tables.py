"""Daily tables of an export: bounds from names, late hits, intraday tables, incremental refresh, atomic replacement."""
import os

import pytest
from pyspark.sql import functions as F

from wayfare.sources import files
from wayfare.sources import ga4 as G
from wayfare.sources.driver import nested_export, read_events
from wayfare.sources.refresh import refresh_flat_events
from wayfare.sources.tables import commits, current, load_model, read_flat_events, read_table, save_model, write_flat_events, write_table

SF = "/root/testdata/sf0.001"
SCHEMA = ("event_date string, user_pseudo_id string, event_timestamp long, event_name string, event_value_in_usd double, "
          "event_params array<struct<key:string,value:struct<string_value:string,int_value:long>>>")


def _table(spark, root, name, rows, schema=SCHEMA):
    rows = [(*r, *[None] * (len(schema.split(", ")) - len(r))) if len(r) < 6 else r for r in rows]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}")


def _hit(day, n=1, user="u"):
    return (day, user, n, "page_view", None, [("page_location", (f"/p{n}", None))])


def test_bounds_come_from_the_table_names(spark, tmp_path):
    """A shard before the period is not read, though its late rows carry a date within it."""
    root = str(tmp_path)
    _table(spark, root, "events_20260101", [_hit("20260101")])
    _table(spark, root, "events_20251231", [_hit("20260101", 2)])
    for path in (root, f"{root}/events_*"):
        assert G.read_export(spark, path, start="20260101").count() == 1
        assert G.read_export(spark, path, start="20251231").count() == 2
        assert G.read_export(spark, path).count() == 2
        assert G.read_export(spark, path, "20251201", "20251231").count() == 0       # the late-hit guard


def test_pruned_tables_are_never_opened(spark, tmp_path):
    root = str(tmp_path)
    for day in ("20260101", "20260102", "20260103"):
        _table(spark, root, f"events_{day}", [_hit(day)])
    broken = tmp_path / "events_20260109"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("no parquet")
    df = G.read_export(spark, root, "20260102", "20260103")
    assert df.count() == 2 and len(df.inputFiles()) == 2
    assert G.read_daily(spark, root, "20260102", "20260103").select("shard").distinct().count() == 2


def test_names_that_are_no_day_and_intraday_tables(spark, tmp_path):
    root = str(tmp_path)
    for name in ("events_20260101", "events_intraday_20260101", "events_intraday_20260102", "events_20261399", "events_2026010",
                 "events_20260103_copy", "users_20260101", "events_fresh_20260101"):
        _table(spark, root, name, [_hit("20260101" if "0101" in name else "20260102")])
    spark.createDataFrame([_hit("20260104")], SCHEMA).coalesce(1).write.parquet(f"{root}/_one")
    (part,) = [f for f in os.listdir(f"{root}/_one") if f.endswith(".parquet")]
    os.link(f"{root}/_one/{part}", f"{root}/events_20260104.parquet")
    assert [d.shard for d in G.daily_tables(spark, root)] == ["20260101", "20260104"]
    with_intraday = G.daily_tables(spark, root, intraday=True)
    assert [(d.shard, d.intraday) for d in with_intraday] == [("20260101", False), ("20260102", True), ("20260104", False)]
    assert sorted(r.event_date for r in G.read_export(spark, root, "20260101").collect()) == ["20260101", "20260104"]
    got = G.read_daily(spark, root, intraday=True).select("shard", "event_date").collect()
    assert sorted(tuple(r) for r in got) == [("20260101", "20260101"), ("20260102", "20260102"), ("20260104", "20260104")]


def test_a_bound_that_cannot_be_applied_raises(spark, tmp_path):
    _table(spark, str(tmp_path), "plain", [_hit("20260101")])
    with pytest.raises(ValueError, match="shard"):
        G.read_export(spark, f"{tmp_path}/plain", start="20260101")
    assert G.read_export(spark, f"{tmp_path}/plain").count() == 1
    with pytest.raises(ValueError, match="no table"):
        G.read_daily(spark, f"{tmp_path}/plain")


def test_tables_whose_columns_differ(spark, tmp_path):
    root = str(tmp_path)
    _table(spark, root, "events_20260101", [_hit("20260101")])
    spark.createDataFrame([(*_hit("20260102"), 7)], SCHEMA + ", batch_event_index long").write.parquet(f"{root}/events_20260102")
    spark.createDataFrame([(*_hit("20260103"), "x")], SCHEMA + ", other string").write.parquet(f"{root}/events_20260103")
    newest = G.read_daily(spark, root)
    assert "other" in newest.columns and "batch_event_index" not in newest.columns and newest.count() == 3
    every = G.read_daily(spark, root, merge_schema=True)
    assert {"other", "batch_event_index", "shard"} <= set(every.columns) and every.filter("batch_event_index = 7").count() == 1


def test_written_tables_hold_the_export(spark, tmp_path):
    root, raw = str(tmp_path / "x"), nested_export(read_events(spark, SF))
    days = G.write_daily(raw, root)
    assert days == sorted(r.shard for r in raw.select("shard").distinct().collect())
    back = G.read_daily(spark, root)
    assert back.select(sorted(raw.columns)).exceptAll(raw.select(sorted(raw.columns))).count() == 0 and back.count() == raw.count()
    one = raw.filter("shard = '20240110'").limit(3)
    G.write_daily(one, root)                         # replaces its own day only
    assert G.read_daily(spark, root, "20240110", "20240110").count() == 3
    assert G.read_daily(spark, root).count() == raw.filter("shard <> '20240110'").count() + 3
    with pytest.raises(ValueError, match="no day"):
        G.write_daily(raw.limit(1).withColumn("shard", F.lit("soon")), root)


# -- refresh ----------------------------------------------------------------------

def _rows(df):
    return sorted(tuple(r) for r in df.select("event_date", "user_pseudo_id", "event_timestamp", "page_location").collect())


def _partitions(folder):
    return {d: os.stat(f"{folder}/{d}").st_mtime_ns for d in os.listdir(folder) if d.startswith("event_date=")}


def test_refresh_equals_a_full_rebuild_and_writes_touched_dates_only(spark, tmp_path):
    root, table, full = (str(tmp_path / n) for n in ("export", "flat", "full"))

    def check(changed, dates, read):
        before = _partitions(table) if os.path.exists(table) else {}
        done = refresh_flat_events(spark, root, table)
        assert (done.changed, done.dates, done.read) == (changed, dates, read)
        after = _partitions(table)
        assert {d for d in before | after if before.get(d) != after.get(d)} == {f"event_date={d}" for d in dates}
        write_flat_events(G.read_export(spark, root), full)
        assert _rows(read_flat_events(spark, table)) == _rows(read_flat_events(spark, full))

    d1, d2, d3, d4 = "20260101", "20260102", "20260103", "20260104"
    _table(spark, root, f"events_{d1}", [_hit(d1, 1), _hit(d1, 2)])
    _table(spark, root, f"events_{d2}", [_hit(d2, 3), _hit(d1, 4)])
    check([d1, d2], [d1, d2], [d1, d2])
    check([], [], [])
    _table(spark, root, f"events_{d3}", [_hit(d3, 5), _hit(d2, 6)])          # a late hit of the day before
    check([d3], [d2, d3], [d2, d3])
    _table(spark, root, f"events_{d2}", [_hit(d2, 3), _hit(d2, 7)])          # rewritten without its late hit
    check([d2], [d1, d2], [d1, d2, d3])
    _table(spark, root, f"events_{d4}", [_hit(d4, 8)])
    check([d4], [d4], [d4])
    files.delete(spark, f"{root}/events_{d4}")                               # gone: its date loses its partition
    check([d4], [d4], [])


def test_refresh_reads_the_still_filling_day(spark, tmp_path):
    root, table = str(tmp_path / "export"), str(tmp_path / "flat")
    _table(spark, root, "events_20260101", [_hit("20260101", 1)])
    _table(spark, root, "events_intraday_20260102", [_hit("20260102", 2)])
    assert refresh_flat_events(spark, root, table).dates == ["20260101"]
    assert refresh_flat_events(spark, root, table, intraday=True).dates == ["20260102"]
    _table(spark, root, "events_20260102", [_hit("20260102", 2), _hit("20260102", 3)])
    assert refresh_flat_events(spark, root, table, intraday=True).dates == ["20260102"]
    assert read_flat_events(spark, table).count() == 3


# -- atomic replacement --------------------------------------------------------------

def test_a_failing_write_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(5), path)
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        write_table(bad, path)
    assert read_table(spark, path).count() == 5 and len(commits(spark, path)) == 1
    assert len([d for d in os.listdir(path) if d.startswith("snapshot")]) == 1


def test_a_table_may_be_rewritten_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    t = write_table(spark.range(5).withColumn("part", F.col("id") % 2), path)
    older = read_table(spark, path)
    t = write_table(t.union(t), path, partition_by=["part"])
    assert t.count() == 10 and older.count() == 5                 # a reader of the last snapshot keeps it
    for n in (20, 40, 80):
        t = write_table(t.union(read_table(spark, path)), path)
        assert t.count() == n
    assert len(commits(spark, path)) == 2 and [v for v, _ in commits(spark, path)] == [4, 5]
    assert {f"{path}/{d}" for d in os.listdir(path) if d.startswith("snapshot")} == {f for _, f in commits(spark, path)}
    assert current(spark, path) == commits(spark, path)[-1][1]


def test_plain_folders_are_read_as_they_are(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert read_table(spark, path).count() == 3 and current(spark, path) == path
    write_table(spark.range(4), path)
    assert read_table(spark, path).count() == 4


def test_models_are_replaced_the_same_way(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    path = str(tmp_path / "m")
    for cols in (["a"], ["a", "b"], ["b"]):
        save_model(Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="v")]).fit(spark.createDataFrame([(1, 2)], "a int, b int")), path, spark)
        assert load_model(path, spark).stages[0].getInputCols() == cols
    assert len(commits(spark, path)) == 2


def test_training_is_kept_for_the_events_as_they_are(spark, tmp_path, monkeypatch):
    from wayfare.plans import queries as Q
    made = []
    monkeypatch.setattr(Q.PR, "fit_propensity", lambda df, **k: made.append(df.count()) or _Model())
    monkeypatch.setattr(Q, "save_model", lambda model, path, spark: None)
    monkeypatch.setattr(Q, "load_model", lambda path, spark: None)
    monkeypatch.setattr(Q.PR, "score", lambda model, df: df.withColumn("propensity_score", F.lit(0.5)))
    sf = str(tmp_path)
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"{sf}/events.parquet")
    one, again = (Q.propensity_train_predict(spark, sf).count() for _ in range(2))
    assert one == again and len(made) == 1
    old = Q._TRAINED[spark.sparkContext.applicationId, sf][1]
    events.filter("user_id % 2 = 0").write.mode("overwrite").parquet(f"{sf}/events.parquet")
    assert Q.propensity_train_predict(spark, sf).count() != one and len(made) == 2
    assert not files.exists(spark, old)


class _Model:
    pass
