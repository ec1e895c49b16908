"""Scores of a saved model against its trees walked in plain Python; importance against the trees' gains."""
import math

import pytest
from pyspark.sql import functions as F

from wayfare.operators import propensity as PR
from wayfare.sources.tables import current, load_model, save_model

pytestmark = pytest.mark.filterwarnings("ignore")


def _table(spark, n=900):
    return spark.range(n).select(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("user_pseudo_id"),
        *[F.when(F.pmod(F.xxhash64("id", F.lit(i + 50)), F.lit(9)) > 0, F.pmod(F.xxhash64("id", F.lit(i)), F.lit(6)).cast("double") / 4).alias(c)
          for i, c in enumerate(PR.FEATURES)],
        F.element_at(F.array(F.lit("US"), F.lit("UK"), F.lit("IT"), F.lit(None).cast("string")), (F.col("id") % 4 + 1).cast("int")).alias("market")) \
        .fillna(0.0, PR.FEATURES).withColumn("target_conversion", ((F.col("visits_7d") + F.col("quote_page_visits_30d") > 1.5)
                                                                   | (F.col("market") == "UK")).cast("int")).fillna({"target_conversion": 0})


def _walk(trees, row):
    margin = 0.0
    for nodes in trees.values():
        at = nodes[0]
        while at.feature is not None:
            x = float(row[at.feature])
            left = x <= at.threshold if at.threshold is not None else x in at.left_values
            at = nodes[at.left if left else at.right]
        margin += at.weight * at.prediction
    return 1 / (1 + math.exp(-2 * margin))


@pytest.mark.parametrize("market", [False, True])
def test_every_score_equals_walking_the_saved_trees(spark, tmp_path, market):
    df, path = _table(spark).cache(), str(tmp_path / "model")
    save_model(PR.fit_propensity(df, seed=5, max_iter=12, include_market=market), path, spark)
    model, nodes = load_model(path, spark), PR.tree_nodes(spark, current(spark, path)).collect()
    trees = {}
    for n in nodes:
        trees.setdefault(n.tree, {})[n.node] = n
    names = PR.model_features(market)
    assert {n.feature for n in nodes} - {None} <= set(names) and len(trees) == model.stages[-1].getNumTrees
    if market:
        assert any(n.left_values is not None for n in nodes)
    rows = model.stages[0].transform(df) if market else df
    want = {r.user_pseudo_id: _walk(trees, r) for r in rows.collect()}
    got = {r.user_pseudo_id: r.propensity_score for r in PR.score(model, df).collect()}
    assert got.keys() == want.keys() and max(abs(got[u] - want[u]) for u in got) < 1e-9
    assert len({round(v, 6) for v in got.values()}) > 20


def test_importance_names_the_features_of_the_saved_assembler(spark, tmp_path):
    df, path = _table(spark).cache(), str(tmp_path / "model")
    save_model(PR.fit_propensity(df, seed=5, max_iter=8), path, spark)
    model = load_model(path, spark)
    used = {n.feature for n in PR.tree_nodes(spark, current(spark, path)).collect()} - {None}
    importance = {r.feature: r.importance for r in PR.feature_importance(model, spark).collect()}
    assert list(importance) and {f for f, v in importance.items() if v > 0} == used
    assert math.isclose(sum(importance.values()), 1.0, abs_tol=1e-9)
    assert model.stages[0].getInputCols() == PR.FEATURES == list(PR.model_features())
