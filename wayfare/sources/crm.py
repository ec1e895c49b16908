"""Explicit schemas for the CRM and curated tables the analyses read.

Only the tables touched by the analyses get a schema (booking role and
header, web requests, identity clusters, curated visitor tables); the rest
of the CRM glossary is documentation without types.  Reading with an
explicit schema avoids a schema-inference pass over the files and fails
fast on drift.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

S, L, D, TS, B, DB = (T.StringType(), T.LongType(), T.DateType(), T.TimestampNTZType(),
                      T.BooleanType(), T.DoubleType())


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "booking_role": _schema(("IndividualId", L), ("BkgCod", S)),
    "booking_header": _schema(("BkgCod", S), ("BkgStatus", S), ("ConfirmationDate", D)),
    "web_request": _schema(("IndividualId", L), ("uwrid", S), ("Date", D), ("RequestTypology", S)),
    "super_id": _schema(("super_id", S), ("google_ids", T.ArrayType(S))),
    "super_id_latest_individual_id": _schema(("super_id", S), ("latest_individual_id", L)),
    "visitor_segments": _schema(("visitor_id", S), ("date", D), ("segment", S), ("market", S),
                                ("device_category", S), ("visit_channel", S)),
    "visit_leads": _schema(("visitor_id", S), ("web_request_type", S), ("webq_source", S),
                           ("event_timestamp", TS), ("net_cruise_revenue", DB), ("booking_status", S)),
    "visits": _schema(("visitor_id", S), ("visit_id", S), ("visit_start_timestamp", TS), ("is_bounce", B),
                      ("pageview_count", L), ("content_interaction_count", L)),
}


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Parquet table read with its declared schema (no inference pass)."""
    return spark.read.schema(SCHEMAS[table]).parquet(path)


def conforms(df: DataFrame, table: str) -> bool:
    """True when ``df`` has exactly the declared columns and types."""
    want = [(f.name, f.dataType) for f in SCHEMAS[table].fields]
    have = [(f.name, f.dataType) for f in df.schema.fields]
    return want == have
