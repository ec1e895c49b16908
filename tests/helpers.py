"""Small in-memory fixtures in the flat event-view schema."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

from wayfare.sources.driver import FLAT_COLUMNS

_LONG = {"event_id", "event_timestamp", "ga_session_id"}
_DOUBLE = {"event_value_in_usd"}


def schema():
    fields = []
    for c in FLAT_COLUMNS:
        if c in _LONG:
            t = T.LongType()
        elif c in _DOUBLE:
            t = T.DoubleType()
        elif c == "event_ts":
            t = T.TimestampNTZType()
        else:
            t = T.StringType()
        fields.append(T.StructField(c, t, True))
    return T.StructType(fields)


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def micros(d: dt.datetime) -> int:
    return int((d - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def ev(event_id, user, when: str, name, session=None, **params):
    d = ts(when)
    row = {c: None for c in FLAT_COLUMNS}
    row.update(event_id=event_id, user_pseudo_id=user, event_ts=d, event_timestamp=micros(d),
               event_date=d.strftime("%Y%m%d"), event_name=name,
               ga_session_id=session if session is not None else None)
    row.update(params)
    if "page_location" in params and "raw_url" not in params:
        row["raw_url"] = params["page_location"]
    return row


def events_df(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in FLAT_COLUMNS) for r in rows], schema())
