"""Tree regressors on cells of binned features, against MLlib's fits on the rows."""

import math
import re

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from tessera.operators import binned
from tessera.operators import ml as M

NAMES = ["linear_regression", "decision_tree", "random_forest", "gradient_boosting"]
FEATURES = ["a", "b"]


def rows(spark, n, wide=False):
    """a: 5 values with zero, or about as many as rows; b: 3 values with a negative; y: depends on both, not evenly."""
    a = F.rand(3) * F.rand(4) * 90 if wide else (F.col("id") * 7 % 5).cast("double")
    df = spark.range(0, n, 1, 3).select(a.alias("a"), ((F.col("id") % 3).cast("int") - 1).alias("b"), F.rand(5).alias("e"))
    y = F.col("a") * (2 + F.col("b")) + F.when(F.col("a") > 3, 6.0).otherwise(0.0) + F.col("e")
    return df.select("a", "b", y.alias("y"), F.when(F.col("e") * 1000 % 1 < 0.2, "test").otherwise("train").alias("split"))


def split(df):
    data = df.select(*FEATURES, "y", "split").persist()
    return data, data.where("split != 'test'"), data.where("split = 'test'")


@pytest.mark.parametrize("wide", [False, True])
def test_trees_and_boosting_are_those_of_the_rows(spark, wide):
    """Also where borders come from a sample (over 10 000 rows of many values): all predictions are the same."""
    data, train, test = split(rows(spark, 30_000 if wide else 3_000, wide))
    chosen, cells = M.tree_cells(train, FEATURES, "y", ["decision_tree", "gradient_boosting"], maxIter=4)
    assert chosen == ["decision_tree", "gradient_boosting"] and cells.size == (99 if wide else 15)
    for name in chosen:
        new = cells.predict(M.estimator(name, "regression", maxIter=4), test).select(*FEATURES, "y", F.col("prediction").alias("p"))
        old = M.fit(train, FEATURES, "y", name, "regression", maxIter=4).transform(test).select(*FEATURES, "y", "prediction")
        new, old = sorted(map(tuple, new.collect())), sorted(map(tuple, old.collect()))
        assert len(new) == len(old) > 400
        assert all(x[:3] == z[:3] and math.isclose(x[3], z[3], rel_tol=1e-9, abs_tol=1e-9) for x, z in zip(new, old))
    cells.close()
    data.unpersist()


def test_tree_estimators_see_cells_not_rows(spark, monkeypatch):
    seen, fit = [], Pipeline.fit

    def watched(self, dataset, params=None):
        seen.append((type(self.getStages()[-1]).__name__, dataset.count()))
        return fit(self, dataset, params)

    monkeypatch.setattr(Pipeline, "fit", watched)
    df = rows(spark, 25_000)  # 15 cells, more than 1000 training rows each
    scores = {r.model: r.score for r in M.train_many(df, FEATURES, "y", "regression", NAMES, metric="r2", numTrees=7, maxIter=3).collect()}
    assert list(scores) == NAMES and all(0.6 < s <= 1 for s in scores.values()) and scores["decision_tree"] > 0.97
    trees = [n for model, n in seen if model != "LinearRegression"]
    assert len(trees) == 9 and max(trees) <= 30  # one tree, seven of the forest, one boosting
    assert [n for model, n in seen if model == "LinearRegression"][0] == df.where("split != 'test'").count()


def test_few_rows_a_cell_are_fitted_as_rows(spark):
    df = rows(spark, 1_500, wide=True)
    scores = {r.model: r.score for r in M.train_many(df, FEATURES, "y", "regression", NAMES, metric="r2", numTrees=3, maxIter=2).collect()}
    data, train, test = split(df)
    ev = RegressionEvaluator(labelCol="y", metricName="r2")
    for n in NAMES:
        assert scores[n] == ev.evaluate(M.fit(train, FEATURES, "y", n, "regression", numTrees=3, maxIter=2).transform(test))
    assert M.tree_cells(train, FEATURES, "y", NAMES) == ([], None)
    data.unpersist()


def test_bootstraps_are_poisson_by_row_and_differ(spark):
    data, train, _ = split(rows(spark, 40_000))
    n = train.count()
    cells = binned.Cells(train, FEATURES, "y", binned.borders(train, FEATURES, n, 42), 42, trees=7)
    assert cells.all_rows.agg(F.sum("n0")).first()[0] == n
    drawn = [dict(f.select("_cell", f"n{i}").collect()) for f, k in zip(cells.drawn, (5, 2)) for i in range(k)]
    size = dict(cells.all_rows.select("_cell", "n0").collect())
    for one in drawn:
        assert all(w == int(w) and abs(w - size[c]) < 6 * math.sqrt(size[c]) for c, w in one.items())
    assert len({tuple(sorted(one.items())) for one in drawn}) == 7
    share = spark.range(200_000).select(F.rand(1).alias("u")).select(binned._poisson(F.col("u"), 1.0).alias("k")).groupBy("k").count().collect()
    for r in share:
        expected = 200_000 * math.exp(-1) / math.factorial(int(r.k))
        assert abs(r["count"] - expected) < 6 * math.sqrt(expected) + 3
    cells.close()
    data.unpersist()


def test_forest_scores_lie_in_the_spread_of_rows(spark):
    data, train, test = split(rows(spark, 20_000))
    ev = RegressionEvaluator(labelCol="y", metricName="r2")
    cuts = binned.borders(train, FEATURES, train.count(), 42)
    old, new = [], []
    for seed in (1, 50, 99):
        old.append(ev.evaluate(M.fit(train, FEATURES, "y", "random_forest", "regression", numTrees=12, seed=seed).transform(test)))
        cells = binned.Cells(train, FEATURES, "y", cuts, seed, trees=12)
        new.append(ev.evaluate(cells.predict(M.estimator("random_forest", "regression", numTrees=12, seed=seed), test)))
        cells.close()
    assert abs(sum(old) - sum(new)) / 3 < 0.1 and len(set(new)) == 3
    data.unpersist()


def test_borders_hold_all_of_mllibs_thresholds(spark):
    data, train, _ = split(rows(spark, 30_000, wide=True))
    cuts = binned.borders(train, FEATURES, train.count(), 42)
    assert [len(c) for c in cuts] == [32, 2]  # as MLlib: one more than maxBins allows, where the sample is larger than expected
    text = M.fit(train, FEATURES, "y", "decision_tree", "regression").stages[-1].toDebugString
    found = {(int(f), float(t)) for f, t in re.findall(r"feature (\d+) <= (-?[\d.E-]+)\)", text)}
    assert len(found) > 20 and found <= {(i, c) for i, cut in enumerate(cuts) for c in cut}
    data.unpersist()


def test_split_points_of_few_values_zeros_and_many_values():
    assert binned.split_points({}, 10.0, 0, 32) == []
    assert binned.split_points({1.0: 4.0, 3.0: 6.0}, 10.0, 10, 32) == [2.0]
    assert binned.split_points({1.0: 4.0, 3.0: 5.0}, 10.0, 9, 32) == [0.5, 2.0]  # a row is missing: it was zero
    assert binned.split_points({float(i): 1.0 for i in range(1, 9)}, 8.0, 8, 4) == [2.5, 4.5, 6.5]
    assert binned.split_points({1.0: 97.0, 2.0: 1.0, 3.0: 1.0, 4.0: 1.0}, 100.0, 100, 3) == [1.5, 2.5]


def test_gaps_in_training_rows_raise_and_in_held_out_rows_go_right(spark):
    base = rows(spark, 3_000)
    for bad in ("cast('nan' as double) as a, 1 as b, 1.0d as y", "1.0d as a, cast(null as int) as b, 1.0d as y", "1.0d as a, 1 as b, cast(null as double) as y"):
        df = base.unionByName(spark.sql(f"select {bad}, 'train' as split"))
        with pytest.raises(Exception, match="must not be null|MUST NOT"):
            M.train_many(df, FEATURES, "y", "regression", ["decision_tree"], metric="r2")
    df = base.unionByName(spark.sql("select cast(null as double) as a, 1 as b, 1.0d as y, 'test' as split union all select double('nan'), 1, 2.0d, 'test'"))
    data, train, test = split(df)
    gaps = test.where("a is null or isnan(a)")
    _, cells = M.tree_cells(train, FEATURES, "y", ["decision_tree"])
    new = [r.prediction for r in cells.predict(M.estimator("decision_tree", "regression"), gaps).collect()]
    old = [r.prediction for r in M.fit(train, FEATURES, "y", "decision_tree", "regression").transform(gaps).collect()]
    assert len(new) == 2 and new == pytest.approx(old)
    cells.close()
    data.unpersist()
