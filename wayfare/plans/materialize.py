"""Materialised propensity pipeline (training set -> split -> model -> scores -> segments).

Each arrow is a written table or a saved model in the shared warehouse
folder, so every stage can be re-run or resumed on its own.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wayfare.operators import propensity as PR
from wayfare.plans import params as P
from wayfare.sources import driver as D
from wayfare.sources.tables import current, save_model, warehouse_dir, write_table


def run(spark: SparkSession, sf_dir: str, out: str | None = None) -> dict[str, str]:
    out = out or warehouse_dir(spark, "propensity")

    def features(anchors):
        period = PR.feature_period(anchors[0], anchors[1], P.LOOKBACK_DAYS, P.HORIZON_DAYS)
        return PR.build_features(D.read_events(spark, sf_dir, period=period), *anchors, P.LOOKBACK_DAYS, P.HORIZON_DAYS)

    paths = {k: f"{out}/{k}" for k in ("training", "scoring", "split", "model", "predictions", "segments",
                                        "lift", "metrics", "importance")}
    train = write_table(features(P.TRAIN_ANCHORS), paths["training"], ["anchor_date"])
    scoring = write_table(features(P.SCORE_ANCHORS), paths["scoring"], ["anchor_date"])
    split = write_table(PR.split_by_user(train, P.TEST_SHARE, P.SPLIT_SEED), paths["split"])
    model = PR.fit_propensity(split.filter(~F.col("dataset_split")), seed=P.SPLIT_SEED)
    save_model(model, paths["model"], spark)
    test_scored = PR.score(model, split.filter("dataset_split"))
    preds = write_table(PR.score(model, scoring), paths["predictions"])     # scored once, read back below
    write_table(PR.lift_by_band(test_scored), paths["lift"])
    write_table(PR.evaluate(test_scored).withColumn("dataset", F.lit("test_split"))
                .unionByName(PR.evaluate(preds).withColumn("dataset", F.lit("out_of_time"))),
                paths["metrics"])
    write_table(PR.segment_crosstab(preds), paths["segments"])
    write_table(PR.feature_importance(model, spark), paths["importance"])
    return {k: current(spark, p) for k, p in paths.items()}      # the committed snapshots
