"""Propensity pipeline: anchored features, user-level split, boosted trees,
evaluation, lift by band, scoring and segment crosstab.

Feature table: one row per (anchor_date, user) with events of the
``lookback`` days before the anchor ([anchor-30, anchor-1]) and a target
that looks ``horizon`` days ahead ([anchor, anchor+14], both inclusive).

Scale notes
* Every event is read once: its flags are computed once and events are
  reduced to (user, day, session, itinerary, destination, market) and then to
  (user, grain, key, day), where a grain is the user's day, a session, an
  itinerary, a destination or a market (map-side combined, fixed-width buffers).
* Days of users are combined map-side, then dealt out by user once; all later
  steps (grains, sessions, changes, running sums) stay in a user's partition.
  Their number is set, not coalesced: rows multiply only after that exchange.
* No row is copied to the anchors whose window holds its day.  A day's counts
  enter the window at one anchor and leave it at another; a session enters
  with its first day and leaves after its last, a gap between its days shorter
  than the window being bridged.  These *changes* are summed by (user, anchor
  number), and a running sum over a user's changes gives every window's value:
  what is shuffled depends on the events, not on the number of anchors.
* What has no difference (most viewed key, latest market, last day) is picked
  from the user's daily series, one short list of days for each key, next to
  the result row.  A list holds the days of the period, a user the keys of the
  catalogue; neither grows with a user's events.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions import vocab as V
from wayfare.functions.text import regex_extract_or_null

U = "user_pseudo_id"

# The 23 model features in model order (market excluded, as trained).
FEATURES = [
    "visits_vs_count", "visits_no_vs_count", "visits_7d", "visits_14d", "visits_30d",
    "itinerary_page_visits_30d", "destination_page_visits_30d", "max_same_itinerary_30d",
    "max_same_destination_30d", "filtri_fyc_30d", "lead_rab_30d", "lead_raq_30d", "lead_sfo_30d",
    "lead_webq_30d", "quote_page_visits_30d", "days_since_last_visit", "visits_trend",
    "avg_pages_per_visit", "has_lead_any", "quote_to_visit_ratio", "multi_itinerary_interest",
    "multi_destination_interest", "has_seen_guests_info_30d",
]
OUTPUT_COLUMNS = ["anchor_date", U, "target_conversion", *FEATURES[:15], "market",
                  "most_viewed_itinerary", "most_viewed_destination", *FEATURES[15:]]


def _to_date(s: str) -> _dt.date:
    return _dt.date.fromisoformat(s)


class _Anchors:
    """Anchors ``start + i * step`` (0 <= i < n) as numbers i: which of them lie how far after a day."""

    def __init__(self, start: _dt.date, end: _dt.date, step: int):
        self.start, self.step, self.n = start, step, (end - start).days // step + 1

    def first(self, day: Column, least: int) -> Column:
        """First anchor at least ``least`` days after ``day`` (null for a null day)."""
        return F.when(day.isNotNull(), F.greatest(F.ceil((F.datediff(day, F.lit(self.start)) + least) / self.step), F.lit(0)).cast("int"))

    def last(self, day: Column, most: int) -> Column:
        """Last anchor at most ``most`` days after ``day``."""
        return F.when(day.isNotNull(), F.least(F.floor((F.datediff(day, F.lit(self.start)) + most) / self.step), F.lit(self.n - 1)).cast("int"))

    def date(self, i: Column) -> Column:
        return F.date_add(F.lit(self.start), i * self.step)


def feature_period(anchor_start: str, anchor_end: str, lookback: int = 30, horizon: int = 14) -> tuple[str, str]:
    """yyyyMMdd bounds of the events a feature table reads (observation + label windows);
    hand them to the event reader so the scan skips everything else."""
    a0, a1 = _to_date(anchor_start), _to_date(anchor_end)
    return ((a0 - _dt.timedelta(days=lookback)).strftime("%Y%m%d"),
            (a1 + _dt.timedelta(days=horizon)).strftime("%Y%m%d"))


def build_features(events: DataFrame, anchor_start: str, anchor_end: str, step: int,
                   lookback: int = 30, horizon: int = 14, target_events: list[str] | None = None,
                   vocab: V.Vocab = V.DEFAULT_VOCAB, check_labels: bool = False) -> DataFrame:
    """``check_labels=True`` first verifies that the data covers the last
    anchor's label window (``require_label_coverage``)."""
    if check_labels:
        require_label_coverage(events, anchor_end, horizon)
    anchors = _Anchors(_to_date(anchor_start), _to_date(anchor_end), step)
    first_day, last_day = feature_period(anchor_start, anchor_end, lookback, horizon)
    ev = events.filter(F.col("event_date").between(first_day, last_day) & F.col(U).isNotNull())
    series = _daily_series(ev, target_events or [V.LEAD_WBOF_01], vocab)
    # the rows, small again, in as few partitions as they need: a sort of them does not run the steps before twice
    return _window_rows(_changes(series, anchors, lookback, horizon), anchors, lookback).repartition(U, "anchor_date")


# Summed over the window (name in the daily series -> feature) ...
_SUMMED = {"_pv": "page_views_30d", "_itin": "itinerary_page_visits_30d", "_dest": "destination_page_visits_30d",
           "_quote": "quote_page_visits_30d", "_fyc": "filtri_fyc_30d", "_rab": "lead_rab_30d", "_raq": "lead_raq_30d",
           "_sfo": "lead_sfo_30d", "_webq": "lead_webq_30d", "_guests": "guests_days"}
# ... and distinct sessions: feature -> (flag that a session's day must have, days of the window; None: the lookback).
_SESSIONS = {"visits_30d": (None, None), "visits_14d": (None, 14), "visits_7d": (None, 7), "visits_vs_count": ("_vs", None),
             "visits_no_vs_count": ("_novs", None)}
_METRICS = [*_SUMMED.values(), *_SESSIONS, "target_days"]


def _daily_series(ev: DataFrame, target_events: list[str], vocab: V.Vocab) -> DataFrame:
    """(user, grain, key, _day) with counts and flags: one row for each day of a user, session, itinerary, destination, market."""
    url, name = F.col("page_location"), F.col("event_name")
    is_vs = V.is_vs_coalesced(F.col("raw_url"))
    is_quote = url.like(f"%{vocab.quote_host}%")
    # order of a user's events as one number: time, then id (a signed 64-bit number)
    order = F.col("event_timestamp").cast("decimal(38,0)") * F.lit("20000000000000000000").cast("decimal(20,0)") + F.col("event_id")
    counts = {"cnt": F.count(F.lit(1)), "_pv": F.count_if(name == V.PAGE_VIEW),
              "_itin": F.count_if(url.like(V.CRUISES_PATTERN)), "_dest": F.count_if(url.like(V.DESTINATIONS_PATTERN)),
              "_quote": F.count_if(is_quote), "_fyc": F.count_if(name == V.FYC_FILTER), "_rab": F.count_if(name == V.LEAD_RAB),
              "_raq": F.count_if(name == V.LEAD_RAQ), "_sfo": F.count_if(name == V.LEAD_SFO), "_webq": F.count_if(name == V.LEAD_WEBQ)}
    greatest = {"_vs": is_vs.cast("int"), "_novs": (~is_vs).cast("int"),
                "_guests": (is_quote & url.like(V.GUESTS_INFO_PATTERN)).cast("int"),
                "_target": name.isin(target_events).cast("int"), "_order": order.cast("decimal(38,0)")}
    daily = (ev.groupBy(U, F.to_date("event_date", "yyyyMMdd").alias("_day"), F.col("ga_session_id").cast("string").alias("_s"),
                        regex_extract_or_null(url, V.CRUISE_ID_REGEX).alias("_itinerary"),
                        regex_extract_or_null(url, V.DESTINATION_ID_REGEX).alias("_destination"), F.col("market").alias("_m"))
             .agg(*[c.alias(k) for k, c in counts.items()], *[F.max(c).alias(k) for k, c in greatest.items()]))
    # a row feeds its user's day and, where present, its session (a NULL session id is no visit), itinerary, destination, market
    grains = F.array(*[F.struct(F.lit(grain).alias("grain"), key.cast("string").alias("key")) for grain, key in (
        ("day", F.lit(None)), ("sess", F.col("_s")), ("itin", F.col("_itinerary")), ("dest", F.col("_destination")),
        ("market", F.col("_m")))])
    # dealt out by user before rows multiply: every later grouping and window has the user in its key and stays there
    own = daily.repartition(int(daily.sparkSession.conf.get("spark.sql.shuffle.partitions")), U)
    x = (own.withColumn("_g", F.explode(F.filter(grains, lambda g: (g["grain"] == "day") | g["key"].isNotNull())))
         .select("*", F.col("_g.grain").alias("grain"), F.col("_g.key").alias("key")))
    return x.groupBy(U, "grain", "key", "_day").agg(*[F.sum(k).alias(k) for k in counts], *[F.max(k).alias(k) for k in greatest])


def _changes(series: DataFrame, anchors: _Anchors, lookback: int, horizon: int) -> DataFrame:
    """(user, i) with the change of every metric at anchor number i; number -1 carries the user's lists."""
    w = Window.partitionBy(U, "grain", "key").orderBy("_day")
    before, whole = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    day, grain = F.col("_day"), F.col("grain")
    keyed = grain.isin("itin", "dest")
    s = series.withColumn("_days", F.collect_list(F.when(keyed, F.struct(day.alias("day"), F.col("cnt").alias("cnt")))).over(whole)) \
        .withColumn("_last", F.lead("_day").over(w).isNull())
    for flag in ("_vs", "_novs"):
        s = s.withColumn(f"_before{flag}", F.max(F.when(F.col(flag) == 1, day)).over(before))
    s = s.withColumn("_before", F.lag("_day").over(w))

    nothing = F.lit(None).cast("struct<kind:string,key:string,seen:decimal(38,0),day:date,days:array<struct<day:date,cnt:bigint>>>")

    def span(metric: str, first: Column, last: Column, by: Column) -> list[Column]:
        """``by`` more from anchor ``first`` on, as many less after ``last``; nothing if that is no anchor."""
        def change(at: Column, by: Column) -> Column:
            return F.struct(F.when((first <= last) & (by != 0), at).alias("i"), F.lit(_METRICS.index(metric)).alias("metric"),
                            by.cast("long").alias("by"), nothing.alias("item"))
        return [change(first, by), change(last + 1, -by)]

    of_day = [c for k, m in _SUMMED.items() for c in span(m, anchors.first(day, 1), anchors.last(day, lookback), F.col(k))]
    of_day += span("target_days", anchors.first(day, -horizon), anchors.last(day, 0), F.col("_target"))
    of_session = []
    for metric, (flag, days) in _SESSIONS.items():
        # from the day's first anchor on, or after the last one that an earlier day of the session reaches
        length = min(days or lookback, lookback)
        first = F.greatest(anchors.first(day, 1), anchors.last(F.col(f"_before{flag or ''}"), length) + 1)      # ignores nulls
        of_session += span(metric, first, anchors.last(day, length), F.col(flag) if flag else F.lit(1))
    item = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("metric"), F.lit(None).cast("long").alias("by"), F.struct(
        grain.alias("kind"), F.col("key").alias("key"), F.col("_order").alias("seen"), day.alias("day"), F.col("_days").alias("days")).alias("item")))
    none = F.filter(item, lambda e: F.lit(False))
    entries = (F.when(grain == "sess", F.array(*of_session)).when(grain == "day", F.concat(item, F.array(*of_day)))
               .when(keyed, F.when(F.col("_last"), item).otherwise(none)).otherwise(item))
    rows = s.select(U, F.explode(F.filter(entries, lambda e: e["i"].isNotNull() & (e["i"] < anchors.n))).alias("e")) \
        .select(U, "e.i", "e.metric", "e.by", "e.item")
    # sums by a hash first (an item is a group of its own), so that collecting lists, which sorts, sees few rows
    summed = rows.groupBy(U, "i", "item").agg(*[F.sum(F.when(F.col("metric") == k, F.col("by"))).alias(m) for k, m in enumerate(_METRICS)])
    return summed.groupBy(U, "i").agg(*[F.sum(m).alias(m) for m in _METRICS], F.collect_list("item").alias("items"))


def _window_rows(changes: DataFrame, anchors: _Anchors, lookback: int) -> DataFrame:
    """One row an anchor and user with a visit in the window: running sums of the changes, picks from the lists."""
    w = Window.partitionBy(U).orderBy("i")
    states = (changes.select(U, "i", *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(m) for m in _METRICS],
                             F.first("items").over(w).alias("items"), F.lead("i").over(w).alias("_next"))
              .filter((F.col("i") >= 0) & (F.col("visits_30d") > 0))
              .withColumn("_i", F.explode(F.sequence("i", F.coalesce("_next", F.lit(anchors.n)) - 1)))
              .withColumn("anchor_date", anchors.date(F.col("_i"))))
    since, until = F.date_sub("anchor_date", lookback), F.date_sub("anchor_date", 1)

    def seen(kind: str) -> Column:
        return F.filter("items", lambda e: (e["kind"] == kind) & e["day"].between(since, until))

    def in_window(kind: str) -> Column:
        """(-events, key) of every key seen in the window: the least is the most viewed, of equals the lowest id."""
        counted = F.transform(F.filter("items", lambda e: e["kind"] == kind), lambda e: F.struct(
            (-F.aggregate(F.filter(e["days"], lambda d: d["day"].between(since, until)), F.lit(0).cast("long"),
                          lambda acc, d: acc + d["cnt"])).alias("less"), e["key"].alias("key")))
        return F.filter(counted, lambda e: e["less"] < 0)

    f = (states.withColumn("_it", in_window("itin")).withColumn("_de", in_window("dest"))
         .withColumn("_top_it", F.array_min("_it")).withColumn("_top_de", F.array_min("_de")))
    visits = F.col("visits_30d")
    leads = F.col("lead_rab_30d") + F.col("lead_raq_30d") + F.col("lead_sfo_30d") + F.col("lead_webq_30d")

    def flag(c: Column) -> Column:
        return F.when(c, 1).otherwise(0)
    return f.select(
        "anchor_date", U, flag(F.col("target_days") > 0).alias("target_conversion"),
        *[c for c in FEATURES[:7]],
        F.coalesce(-F.col("_top_it.less"), F.lit(0)).alias("max_same_itinerary_30d"),
        F.coalesce(-F.col("_top_de.less"), F.lit(0)).alias("max_same_destination_30d"),
        *[c for c in FEATURES[9:15]],
        F.array_max(F.transform(seen("market"), lambda e: F.struct(e["seen"].alias("seen"), e["key"].alias("key"))))["key"].alias("market"),
        F.col("_top_it.key").alias("most_viewed_itinerary"), F.col("_top_de.key").alias("most_viewed_destination"),
        F.datediff("anchor_date", F.array_max(F.transform(seen("day"), lambda e: e["day"]))).alias("days_since_last_visit"),
        F.try_divide(F.col("visits_7d"), visits).alias("visits_trend"),
        F.try_divide(F.col("page_views_30d"), visits).alias("avg_pages_per_visit"),
        flag(leads > 0).alias("has_lead_any"),
        F.try_divide(F.col("quote_page_visits_30d"), visits).alias("quote_to_visit_ratio"),
        flag(F.size("_it") > 1).alias("multi_itinerary_interest"), flag(F.size("_de") > 1).alias("multi_destination_interest"),
        flag(F.col("guests_days") > 0).alias("has_seen_guests_info_30d"),
    ).select(*OUTPUT_COLUMNS)


def require_label_coverage(events: DataFrame, anchor_end: str, horizon: int = 14) -> None:
    """Raise when the events end before the last anchor's label window does
    (labels of the last anchors would be silently truncated).  Reads one
    single-row aggregate."""
    row = label_coverage(events, anchor_end, horizon).first()
    if row is None or not row.covered:
        raise ValueError(f"events end {row.data_end if row else None}, labels need {row.label_end if row else '?'}"
                         f" (anchor {anchor_end} + {horizon} days)")


def label_coverage(events: DataFrame, anchor_end: str, horizon: int = 14) -> DataFrame:
    """One row: last event day, last day the labels need, and whether the data covers it."""
    need = _to_date(anchor_end) + _dt.timedelta(days=horizon)
    return events.agg(F.max(F.to_date("event_date", "yyyyMMdd")).alias("data_end")) \
        .withColumn("label_end", F.lit(need)).withColumn("covered", F.col("data_end") >= F.col("label_end"))


# ---------------------------------------------------------------------------
# split, model, evaluation
# ---------------------------------------------------------------------------

def user_bucket(seed: int) -> Column:
    """Deterministic 0..99 bucket of a user (md5 prefix; reproducible in any engine)."""
    h = F.md5(F.concat(F.col(U), F.lit("#"), F.lit(str(seed))))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(100))


def split_by_user(features: DataFrame, test: float = 0.2, seed: int = 42, method: str = "hash") -> DataFrame:
    """dataset_split = TRUE (test) for ``test`` of the users; all rows of a user
    land on the same side (no leakage).

    ``hash`` (default): md5 bucket of the user — reproducible, a pure
    projection.  ``rand``: one ``rand(seed)`` draw per distinct user joined
    back (the warehouse behaviour; stable only for a fixed partitioning)."""
    if method == "hash":
        return features.withColumn("dataset_split", user_bucket(seed) < F.lit(int(round(test * 100))))
    if method == "rand":
        users = features.select(U).distinct().withColumn("dataset_split", F.rand(seed) >= F.lit(1 - test))
        return features.join(users, U)
    raise ValueError("method must be hash or rand")


def class_weights(df: DataFrame, label: str = "target_conversion", out: str = "class_weight") -> DataFrame:
    """Balanced weights n / (k * n_c), broadcasting the k-row class-count table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n_c"))
    tot = counts.agg(F.sum("_n_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_n_c"))).alias(out))
    return df.join(F.broadcast(w), label)    # at most one row per class


def model_features(include_market: bool = False) -> list[str]:
    """Assembler inputs: the 23 trained features, plus the indexed market when opted in."""
    return FEATURES + (["market_idx"] if include_market else [])


def _validation_users(train: DataFrame, seed: int, share: float) -> Column:
    """Whether a training user stops the training early: ``share`` of the users by bucket, always the one of
    lowest bucket (ties by id), never the one of highest.  The same rule at every size; two users suffice."""
    bucket = user_bucket(seed + 1)
    ends = train.agg(F.min(F.struct(bucket.alias("b"), F.col(U).alias("u"))).alias("low"),
                     F.max(F.struct(bucket.alias("b"), F.col(U).alias("u"))).alias("high")).first()
    if ends.low is None or ends.low.u == ends.high.u:
        raise ValueError("fewer than two training users: no early-stop split; pass early_stop=False")
    return (F.col(U) == ends.low.u) | ((bucket < F.lit(int(share * 100))) & (F.col(U) != ends.high.u))


def fit_propensity(train: DataFrame, features: list[str] | None = None, seed: int = 42,
                   validation_share: float = 0.2, max_iter: int = 100, include_market: bool = False,
                   early_stop: bool = True):
    """Boosted trees with the reference options mapped to Spark ML.

    learn rate 0.1, depth 6, min child weight 1 (-> minInstancesPerNode),
    row subsample 0.8, column sample 0.8 (per split in Spark), early stop
    with min relative progress 0.001 on a user-level validation split carved
    out of the training users, balanced class weights.  Spark's GBT has no
    L1/L2 leaf penalties.  With ``early_stop`` a single training user is
    refused, never trained otherwise without notice (pass ``early_stop=False``
    to train all rounds)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    features = features or model_features(include_market)
    t = class_weights(train).withColumn("label", F.col("target_conversion").cast("double"))
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    stop = {}
    if early_stop:
        stop = {"validationIndicatorCol": "is_validation", "validationTol": 0.001}
        t = t.withColumn("is_validation", _validation_users(train, seed, validation_share))
    gbt = GBTClassifier(labelCol="label", featuresCol="features", weightCol="class_weight",
                        maxIter=max_iter, stepSize=0.1, maxDepth=6, minInstancesPerNode=1,
                        subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, **stop)
    stages = [asm, gbt]
    if include_market:
        # market is categorical text: index it (unseen / NULL markets get their own index)
        stages.insert(0, StringIndexer(inputCol="market", outputCol="market_idx", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(t)


def score(model, df: DataFrame) -> DataFrame:
    """All input columns + propensity_score = P(label = 1)."""
    from pyspark.ml.functions import vector_to_array
    cols = df.columns
    return model.transform(df).select(*cols, vector_to_array("probability")[1].alias("propensity_score"))


def tree_nodes(spark, saved: str) -> DataFrame:
    """The trees of a saved model (the folder of one snapshot) as a table: one row a node.

    (tree, weight, node, feature, threshold, left_values, left, right, prediction): an inner node names its
    feature (as the assembler orders them) and sends a row left whose value is at most ``threshold`` or, for a
    categorical feature, one of ``left_values``; a leaf has no feature.  The margin is the sum of
    weight * prediction over the trees' leaves, and P(label = 1) = 1 / (1 + exp(-2 margin))."""
    from wayfare.sources.files import entries
    from wayfare.sources.tables import load_model
    assembler = next(s for s in load_model(saved, spark).stages if hasattr(s, "getInputCols") and s.getOutputCol() == "features")
    names = F.array(*[F.lit(c) for c in assembler.getInputCols()])
    folder = max(entries(spark, f"{saved}/stages"), key=lambda e: int(e.name.split("_")[0])).path
    # by position: releases of Spark name the columns of these two files differently
    nodes = spark.read.parquet(f"{folder}/data").toDF("tree", "n").select("tree", "n.*")
    weights = spark.read.parquet(f"{folder}/treesMetadata").toDF("tree", "metadata", "weight").drop("metadata")
    inner, split = F.col("leftChild") >= 0, F.col("split")
    categorical = split["numCategories"] >= 0
    return nodes.join(weights, "tree").select(
        "tree", "weight", F.col("id").alias("node"),
        F.when(inner, F.get(names, split["featureIndex"])).alias("feature"),
        F.when(inner & ~categorical, F.get(split["leftCategoriesOrThreshold"], 0)).alias("threshold"),
        F.when(inner & categorical, split["leftCategoriesOrThreshold"]).alias("left_values"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"), "prediction")


def evaluate(scored: DataFrame, label: str = "target_conversion", threshold: float = 0.5) -> DataFrame:
    """One-row metrics: precision, recall, accuracy, f1, log loss, ROC AUC.

    Both passes (confusion counts and the distributed ROC computation) read a
    persisted two-column projection, so the features and the model transform
    run once; the result is a single row built from the aggregated counts."""
    from pyspark import StorageLevel
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    s = scored.select(F.col(label).cast("double").alias("_y"), F.col("propensity_score").alias("_p")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        y, p = F.col("_y"), F.col("_p")
        pred = (p >= threshold).cast("double")
        eps = 1e-15
        pc = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
        r = s.agg(F.sum(pred * y).alias("tp"), F.sum(pred * (1 - y)).alias("fp"),
                  F.sum((1 - pred) * y).alias("fn"), F.sum((1 - pred) * (1 - y)).alias("tn"),
                  F.avg(-(y * F.log(pc) + (1 - y) * F.log(1 - pc))).alias("log_loss")).first()
        auc = BinaryClassificationEvaluator(rawPredictionCol="_p", labelCol="_y",
                                            metricName="areaUnderROC", numBins=0).evaluate(s)   # 0: every score
    finally:
        s.unpersist()
    tp, fp, fn, tn = (r.tp or 0.0), (r.fp or 0.0), (r.fn or 0.0), (r.tn or 0.0)
    prec = tp / (tp + fp) if tp + fp else None
    rec = tp / (tp + fn) if tp + fn else None
    f1 = 2 * prec * rec / (prec + rec) if prec and rec else None
    acc = (tp + tn) / (tp + tn + fp + fn) if tp + tn + fp + fn else None
    return scored.sparkSession.createDataFrame(
        [(prec, rec, acc, f1, r.log_loss, float(auc))],
        "precision double, recall double, accuracy double, f1_score double, log_loss double, roc_auc double")


def feature_importance(model, spark, features: list[str] | None = None) -> DataFrame:
    if features is None:
        features = model_features(any(getattr(st, "getOutputCol", lambda: "")() == "market_idx"
                                      for st in model.stages))
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


# ---------------------------------------------------------------------------
# lift, segmentation
# ---------------------------------------------------------------------------

# Lower bounds and labels.
LIFT_BANDS = [(0.7, "1. Alta"), (0.4, "2. Medio-Alta"), (0.2, "3. Media"), (0.1, "4. Medio-Bassa")]
LIFT_ELSE = "5. Bassa"


def lift_by_band(scored: DataFrame, label: str = "target_conversion") -> DataFrame:
    """Conversion rate and lift over the overall rate per score band.

    The overall rate is a one-row aggregate cross-joined (broadcast) back."""
    p = F.col("propensity_score")
    band = None
    for lo, name in LIFT_BANDS:
        band = F.when(p >= lo, F.lit(name)) if band is None else band.when(p >= lo, F.lit(name))
    band = band.otherwise(F.lit(LIFT_ELSE))
    s = scored.select(F.col(label).alias("actual"), band.alias("propensity_band"))
    base = s.agg((F.sum("actual") / F.count(F.lit(1))).alias("baseline_rate"))
    per = s.groupBy("propensity_band").agg(F.count(F.lit(1)).alias("users"),
                                           F.sum("actual").cast("long").alias("conversions"))
    rate = F.col("conversions") / F.col("users")
    return (per.crossJoin(F.broadcast(base))
            .select("propensity_band", "users", "conversions",
                    F.round(rate * 100, 3).alias("conversion_rate_pct"),
                    F.round(rate / F.col("baseline_rate"), 1).alias("lift_vs_average")))


SEGMENT_FLAGS = [  # (output column, source column) — fixed values
    ("flag_quote_30d", "quote_page_visits_30d"), ("flag_lead_rab_30d", "lead_rab_30d"),
    ("flag_lead_raq_30d", "lead_raq_30d"), ("flag_lead_sfo_30d", "lead_sfo_30d"),
    ("flag_lead_webq_30d", "lead_webq_30d"), ("flag_visits_vs_count", "visits_vs_count"),
    ("flag_visits_no_vs_count", "visits_no_vs_count"),
]


def segment_crosstab(scored: DataFrame) -> DataFrame:
    """Distinct users per propensity band x market x most-viewed ids x yes/no flags."""
    p = F.col("propensity_score")
    band = (F.when(p > 0.8, F.lit("Alta")).when((p >= 0.4) & (p <= 0.8), F.lit("Media"))
            .when((p > 0) & (p < 0.4), F.lit("Bassa")))

    def yn(c):
        return F.when(F.col(c) > 0, F.lit("Sì")).otherwise(F.lit("No"))
    dims = [band.alias("Propensity"), F.col("market"), F.col("most_viewed_destination"),
            F.col("most_viewed_itinerary"), *[yn(src).alias(out) for out, src in SEGMENT_FLAGS],
            yn("has_seen_guests_info_30d").alias("has_seen_guests_info_30d")]
    return scored.groupBy(*dims).agg(F.count_distinct(U).alias("cnt"))


def rule_score(features: DataFrame) -> DataFrame:
    """Transparent baseline score in [0, 1] from three features (no model):
    0.5 * visits_trend + 0.3 * has_lead_any + 0.2 * has_seen_guests_info_30d.
    Lets lift and segmentation be checked exactly against SQL."""
    s = (F.lit(0.5) * F.coalesce(F.col("visits_trend"), F.lit(0.0))
         + F.lit(0.3) * F.col("has_lead_any").cast("double")
         + F.lit(0.2) * F.col("has_seen_guests_info_30d").cast("double"))
    return features.withColumn("propensity_score", s)
