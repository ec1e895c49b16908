"""GA4 ``event_params`` extraction (repeated key/value structs).

The export stores parameters as ``ARRAY<STRUCT<key, value STRUCT<string_value,
int_value, ...>>>``.  A missing key must give NULL, so we never index the array
directly (ANSI mode raises on out-of-range); ``filter`` + ``get`` returns NULL.
The lookup is a narrow per-row expression inside whole-stage codegen — no
explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("string", "int", "float", "double")


def param(key: str, kind: str = "string", params: str | Column = "event_params") -> Column:
    """Value of parameter ``key`` (first occurrence) or NULL."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    arr = F.col(params) if isinstance(params, str) else params
    hit = F.get(F.filter(arr, lambda p: p["key"] == F.lit(key)), 0)
    return hit["value"][f"{kind}_value"]


def flatten_events(raw: DataFrame, spec: dict[str, tuple[str, str]],
                   keep: tuple[str, ...] = ("user_pseudo_id", "event_timestamp",
                                            "event_date", "event_name"),
                   params: str = "event_params") -> DataFrame:
    """One projection turning nested parameters into typed flat columns.

    ``spec`` maps output column -> (parameter key, kind).  Flattening once at
    ingestion is what lets later predicates on parameters reach the Parquet
    reader as pushed filters (predicates on ``filter(event_params, ...)``
    cannot be pushed).
    """
    cols = [F.col(c) for c in keep if c in raw.columns]
    cols += [param(key, kind, params).alias(name) for name, (key, kind) in spec.items()]
    return raw.select(*cols)


# Parameter spec used by the analyses (output column -> (key, kind)).
DEFAULT_SPEC: dict[str, tuple[str, str]] = {
    "ga_session_id": ("ga_session_id", "int"),
    "page_location": ("page_location", "string"),
    "raw_url": ("raw_url", "string"),
    "lead_name": ("lead_name", "string"),
    "payment_type": ("payment_type", "string"),
    "booking_status": ("booking_status", "string"),
    "p_journey_is_destex": ("p_journey_is_destex", "string"),
    "p_journey_code": ("p_journey_code", "string"),
    "p_departure_date": ("p_departure_date", "string"),
    "p_sub_category": ("p_sub_category", "string"),
    "experiment_id": ("experiment_id", "string"),
    "variation_id": ("variation_id", "string"),
    "cta_name": ("cta_name", "string"),
    "cta_type": ("cta_type", "string"),
    "voyage_funnel_step_name": ("voyage_funnel_step_name", "string"),
    "uwrid": ("uwrid", "string"),
    "market": ("market", "string"),
    "ab_component_tests": ("ab_component_tests", "string"),
}
