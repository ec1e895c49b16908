"""Prospect segmentation of CRM individuals reached through tagged URLs.

Leads are events whose URL carries an individual id; campaign (VS)
contacts are excluded.  Each individual is classified once — converted
(any confirmed booking), prospect (2+ leads) or new (1 lead) — so the
classes are disjoint and add up to the control total.  One aggregation
computes all four counts; ``stack`` turns them into report rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import vocab as V
from wayfare.functions.text import regex_extract_or_null

U = "user_pseudo_id"

LABELS = [  # fixed values: report row labels in report order
    "Prospect (2+ lead, no conversione)",
    "New in DB (1 lead, no conversione)",
    "Con conversione",
    "TOTALE LACAR con lead (no VS)",
]


def prospect_segments(events: DataFrame, bookings: DataFrame, period=None,
                      exclude: Column | None = None) -> DataFrame:
    ev = events if period is None else events.filter(F.col("event_date").between(*period))
    exclude = V.is_vs(F.col("raw_url")) if exclude is None else exclude
    leads = (ev.filter(F.col(U).isNotNull() & F.col("raw_url").like("%IndividualId=%") & ~exclude)
             .select(regex_extract_or_null(F.col("raw_url"), V.INDIVIDUAL_ID_REGEX).alias("IndividualId")))
    lead_count = leads.filter(F.col("IndividualId").isNotNull()).groupBy("IndividualId") \
        .agg(F.count(F.lit(1)).alias("total_leads"))
    converted = bookings.select("IndividualId").distinct().withColumn("_conv", F.lit(1))
    cls = lead_count.join(converted, "IndividualId", "left") \
        .withColumn("has_conversion", F.coalesce("_conv", F.lit(0)))
    counts = cls.agg(
        F.count_if((F.col("total_leads") >= 2) & (F.col("has_conversion") == 0)).alias("c0"),
        F.count_if((F.col("total_leads") == 1) & (F.col("has_conversion") == 0)).alias("c1"),
        F.count_if(F.col("has_conversion") == 1).alias("c2"),
        F.count(F.lit(1)).alias("c3"))
    stack = ", ".join(f"'{lab}', c{i}" for i, lab in enumerate(LABELS))
    return counts.select(F.expr(f"stack({len(LABELS)}, {stack}) AS (categoria, users)"))
