"""String helpers with warehouse NULL semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex_extract_or_null(col: Column, pattern: str, idx: int = 1) -> Column:
    """Capture group ``idx`` or NULL when the pattern does not match.

    Spark's ``regexp_extract`` returns '' on no match; warehouse semantics
    (and every ``IS NOT NULL`` / ``COUNT(DISTINCT)`` built on it) need NULL.
    """
    return F.nullif(F.regexp_extract(col, pattern, idx), F.lit(""))

