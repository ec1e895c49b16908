"""A/B experiment read-outs.

* ``clean_assignments``: users exposed to more
  than one variant are removed (one aggregation per user over the set of
  variants; never ``NOT IN``, which returns nothing as soon as one key is
  NULL).
* ``experiment_report``: per variant, users who saw the popup, general
  conversion flags and post-exposure flags (strictly after the first
  popup view) — one scan, one aggregation per user.
* ``deterministic_sample``: at most N users per variant ordered by a hash
  of the user id — an exact two-level top-N (per variant and salt bucket,
  then per variant), so no task sorts a whole variant.
* ``component_variant``: users in a component-level test variant read from
  a JSON-as-text parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import vocab as V

U, TS = "user_pseudo_id", "event_timestamp"


def exposures(events: DataFrame, experiment_id: str, period: tuple[str, str] | None = None) -> DataFrame:
    ev = events if period is None else events.filter(F.col("event_date").between(*period))
    return ev.filter((F.col("event_name") == V.EXPERIMENT_VIEWED) & (F.col("experiment_id") == experiment_id)
                     & F.col(U).isNotNull()).select(U, "variation_id")


def _variant_rows(vars_col: str = "_vars", null_col: str = "_has_null") -> Column:
    """The user's distinct variants as rows: real variants, plus a NULL row when a
    NULL-variant exposure exists (COUNT(DISTINCT) ignores NULL, so such a user is
    single-variant and stays in as two rows)."""
    return F.when(F.col(null_col) == 1,
                  F.concat(F.col(vars_col), F.array(F.lit(None).cast("string")))).otherwise(F.col(vars_col))


def clean_assignments(expo: DataFrame) -> DataFrame:
    """Distinct (user, variant) of single-variant users, from one aggregation per
    user: the set of variants (at most a handful, ``collect_set``) and a
    NULL-variant flag; users with two or more real variants are dropped.  Same
    rows as excluding multi-variant users with an anti-join, in one shuffle."""
    prof = expo.groupBy(U).agg(
        F.collect_set("variation_id").alias("_vars"),
        F.max(F.col("variation_id").isNull().cast("int")).alias("_has_null"))
    return prof.filter(F.size("_vars") <= 1).select(U, F.explode(_variant_rows()).alias("variation_id"))


def clean_users_per_variant(expo: DataFrame) -> DataFrame:
    return (clean_assignments(expo).groupBy("variation_id")
            .agg(F.count_distinct(U).alias("utenti")))


def deterministic_sample(assign: DataFrame, n: int, key: Column | None = None,
                         salt_buckets: int = 256) -> DataFrame:
    """At most ``n`` users per variant, the ``n`` smallest by a hash of the user id.

    A variant can hold half of all exposed users, and for n above Spark's
    window-group-limit threshold (1000) a plain rank filter would sort a whole
    variant in one task.  Two levels keep it exact and bounded: the n smallest
    within each (variant, salt bucket), then the n smallest of those survivors
    per variant (at most n x ``salt_buckets`` rows).  Every member of the global
    top n is also in the top n of its own bucket, so nothing is lost."""
    key = F.md5(F.col(U)) if key is None else key
    x = assign.withColumn("_key", key).withColumn("_salt", F.pmod(F.xxhash64(F.col(U)), F.lit(salt_buckets)))
    w1 = Window.partitionBy("variation_id", "_salt").orderBy("_key", U)
    x = x.withColumn("_rn", F.row_number().over(w1)).filter(F.col("_rn") <= n)
    w2 = Window.partitionBy("variation_id").orderBy("_key", U)
    x = x.withColumn("_rn", F.row_number().over(w2)).filter(F.col("_rn") <= n)
    return x.drop("_rn", "_key", "_salt")


def popup_seen_users(events: DataFrame, period=None) -> DataFrame:
    ev = events if period is None else events.filter(F.col("event_date").between(*period))
    return (ev.filter((F.col("event_name") == V.CONTENT_CTA) & (F.col("cta_name") == V.CTA_POPUP)
                      & (F.col("cta_type") == V.CTA_POPUP_SEEN) & F.col(U).isNotNull())
            .groupBy(U).agg(F.min(TS).alias("popup_seen_timestamp")))


def experiment_report(events: DataFrame, experiment_id: str, period=None,
                      vocab: V.Vocab = V.DEFAULT_VOCAB, sample: int | None = None) -> DataFrame:
    """Per variant: users who saw the popup and their general / post-popup flags.

    One scan: events are folded to (user, variant seen) with numbers only — for
    each action whether it happened and when last; it happened after the first
    popup exactly when its latest occurrence is after it — and these one to three
    rows to the user.  The first step combines map-side in a hash table; only its
    few rows are sorted for the variant's text.  The per-variant totals are a
    third, tiny aggregation."""
    ev = events if period is None else events.filter(F.col("event_date").between(*period))
    ev = ev.filter(F.col(U).isNotNull())
    name = F.col("event_name")
    expo = (name == V.EXPERIMENT_VIEWED) & (F.col("experiment_id") == experiment_id)
    popup = (name == V.CONTENT_CTA) & (F.col("cta_name") == V.CTA_POPUP) & (F.col("cta_type") == V.CTA_POPUP_SEEN)
    hold = (name == V.GENERATE_LEAD) & (F.col("lead_name") == V.LEAD_NAME_BOOKING)
    buy = V.purchase("C")
    click = (name == V.CONTENT_CTA) & (F.col("cta_name") == V.CTA_RETURN_TO_FUNNEL)
    # the entry URL is the page's own: other URL parameters are not set on every hit
    entry = F.col("page_location").like(f"%{vocab.funnel_host}/%")

    def last(c):
        return F.max(F.when(c, F.col(TS)))
    seen = ev.groupBy(U, F.coalesce(expo, F.lit(False)).alias("_exposed"), F.when(expo, F.col("variation_id")).alias("_variant")).agg(
        F.min(F.when(popup, F.col(TS))).alias("_popup"), last(entry).alias("_entry"), last(hold).alias("_hold_last"),
        last(buy).alias("_buy_last"), last(click).alias("_click_last"))
    per_user = seen.groupBy(U).agg(
        F.min("_variant").alias("_first"), F.max("_variant").alias("_last"),
        F.max((F.col("_exposed") & F.col("_variant").isNull()).cast("int")).alias("_has_null"),
        F.max(F.col("_exposed").cast("int")).alias("_exposed"), F.min("_popup").alias("_popup"),
        *[F.max(c).alias(c) for c in ("_entry", "_hold_last", "_buy_last", "_click_last")])
    for flag, at in (("has_funnel_entry", "_entry"), ("has_booking_hold", "_hold_last"), ("has_purchase", "_buy_last"),
                     ("has_click_popup", "_click_last")):
        per_user = per_user.withColumn(flag, F.col(at).isNotNull().cast("int"))
    rows = (per_user.filter((F.col("_exposed") == 1) & F.col("_first").eqNullSafe(F.col("_last")))
            .select("*", F.explode(F.when(F.col("_first").isNull(), F.array(F.lit(None).cast("string")))
                                   .when(F.col("_has_null") == 1, F.array("_first", F.lit(None).cast("string")))
                                   .otherwise(F.array("_first"))).alias("variation_id")))
    if sample is not None:
        rows = deterministic_sample(rows, sample)       # sampled among all clean exposed users
    rows = rows.filter(F.col("_popup").isNotNull())

    def after(last):
        return F.when(F.col(last) > F.col("_popup"), 1).otherwise(0)
    flags = rows.select(U, "variation_id", "has_funnel_entry", "has_booking_hold", "has_purchase",
                        "has_click_popup", after("_hold_last").alias("has_booking_hold_post_popup"),
                        after("_buy_last").alias("has_purchase_post_popup"),
                        after("_click_last").alias("has_click_popup_post_popup"))

    def both(a, b):
        return F.sum(F.when((F.col(a) == 1) & (F.col(b) == 1), 1).otherwise(0)).cast("long")

    def s(c):
        return F.sum(c).cast("long")

    return flags.groupBy("variation_id").agg(
        F.count(F.lit(1)).alias("utenti_popup_visto"),
        s("has_funnel_entry").alias("funnel_entry"), s("has_booking_hold").alias("booking_hold"),
        s("has_purchase").alias("purchase"), s("has_click_popup").alias("click_popup"),
        both("has_click_popup", "has_booking_hold").alias("click_popup_then_bh"),
        both("has_click_popup", "has_purchase").alias("click_popup_then_purchase"),
        s("has_booking_hold_post_popup").alias("booking_hold_post_popup"),
        s("has_purchase_post_popup").alias("purchase_post_popup"),
        s("has_click_popup_post_popup").alias("click_popup_post_popup"),
        both("has_click_popup_post_popup", "has_booking_hold_post_popup").alias("click_then_bh_post_popup"),
        both("has_click_popup_post_popup", "has_purchase_post_popup").alias("click_then_purchase_post_popup"),
    )


def component_variant(events: DataFrame, test_name: str, variant: str, period=None, strict: bool = True,
                      test_key: str = "test", variant_keys: tuple[str, ...] = ("s", "segmentId")) -> DataFrame:
    """Users (and events) in a component test variant, read from the JSON-as-text parameter.

    The text is parsed as a VARIANT: one object or an array of them, keys in any
    order and spacing; text that is no JSON is in no variant.  ``strict=False``
    matches by text like the dashboards do (test name AND ``"s":"<v>"`` or
    ``"segmentId":"<v>"``), which finds other spellings only by luck.
    """
    ev = events if period is None else events.filter(F.col("event_date").between(*period))
    t = F.col("ab_component_tests")
    if strict:
        parsed = F.try_parse_json(t)
        tests = F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.array(parsed))

        def named(e: Column) -> Column:
            of_variant = F.lit(False)
            for key in variant_keys:
                of_variant = of_variant | F.coalesce(F.try_variant_get(e, f"$.{key}", "string") == variant, F.lit(False))
            return (F.try_variant_get(e, f"$.{test_key}", "string") == test_name) & of_variant
        cond = F.exists(tests, named)
    else:
        cond = F.lit(False)
        for key in variant_keys:
            cond = cond | t.like(f'%"{key}":"{variant}"%')
        cond = t.like(f"%{test_name}%") & cond
    return (ev.filter(t.isNotNull() & cond).groupBy(U)
            .agg(F.count(F.lit(1)).alias("events"), F.min("event_ts").alias("first_seen")))
