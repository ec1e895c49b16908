"""Streaming ingestion: raw events -> flat event view -> classified conversions.

Only the stateless steps are streamed (projection, parameter flattening,
event vocabulary); they run unchanged on ``readStream`` because they are
plain column expressions.  Sessions, reset windows and funnels need the
whole history of a user and stay batch jobs over the written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.operators.sessions import default_conversion_rules
from wayfare.sources.driver import flat_events_from_driver

DRIVER_EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def flat_event_stream(spark: SparkSession, source: str, max_files_per_trigger: int = 100) -> DataFrame:
    raw = (spark.readStream.schema(DRIVER_EVENTS_SCHEMA)
           .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source))
    return flat_events_from_driver(raw)


def classify_conversions(flat: DataFrame) -> DataFrame:
    label = None
    for name, cond in default_conversion_rules().items():
        label = F.when(cond, F.lit(name)) if label is None else label.when(cond, F.lit(name))
    return (flat.select("user_pseudo_id", "event_timestamp", "event_date", "ga_session_id",
                        label.alias("action_type"))
            .filter(F.col("action_type").isNotNull()))


def start_conversion_sink(spark: SparkSession, source: str, sink: str, checkpoint: str,
                          available_now: bool = True):
    """Append classified conversions to a date-partitioned Parquet table.

    The checkpoint folder makes the query restartable after a lost executor
    or driver; the file sink is exactly-once with it."""
    q = (classify_conversions(flat_event_stream(spark, source))
         .writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .partitionBy("event_date").outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()


def start_flat_event_sink(spark: SparkSession, source: str, sink: str, checkpoint: str,
                          available_now: bool = True):
    """Append the flat event view to a table partitioned by ``event_date``.

    The adapter then runs once per event instead of once per analysis; batch
    analyses read the table with partition pruning on the date and column
    pruning on the parameters they use (``sources.tables.read_flat_events``)."""
    q = (flat_event_stream(spark, source).writeStream.format("parquet")
         .option("path", sink).option("checkpointLocation", checkpoint)
         .partitionBy("event_date").outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 minute")
    return q.start()
