"""Small document frames with every awkward row the operators promise to handle."""
from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or add themselves.
CLASHING = ("id", "key", "text_", "copy", "shuffle_key", "component_id", "kept", "fingerprint", "n", "fp", "copies",
            "_id", "_new_text", "n_copies", "z", "tag", "found", "held_out", "verdict")


def docs_df(spark, texts, langs=None, sources=None, first_id=0):
    rows = [(None if i == "null" else first_id + n, t, (langs or ["en"] * len(texts))[n],
             (sources or ["src1"] * len(texts))[n], len(t) if t is not None else None)
            for n, (i, t) in enumerate((x if isinstance(x, tuple) else ("", x)) for x in texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and blank texts, one long text, repeated rows."""
    rng = random.Random(0)
    long_text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(60_000))
    rows = [(1, "", "en", "src0", 0), (2, None, None, None, None), (3, " \n\t ", "fr", "src1", 4),
            (None, "a text without an id", "en", "src1", 20), (4, long_text, "en", "src0", len(long_text)),
            (5, "same row twice over here", "de", "src2", 24), (5, "same row twice over here", "de", "src2", 24),
            (6, "\U0001f600 \u00e9\u0000\u4e2d\u6587 12 34", None, "src9", 9)]
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
