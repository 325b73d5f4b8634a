"""Learning curves on nested training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.stats import rnd
from .ml import fit, fold_column

CELLS = 10_000


def nested(df: DataFrame, key: list[str], seed: int = CONFIG.seed):
    """``df`` with ``cell``, a hash of the key: rows with cell < share * CELLS are a training set, and each contains those of smaller shares."""
    return df.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed + 7), *key), F.lit(CELLS)))


def learning_curve(df: DataFrame, features: list[str], label: str, name: str, task: str, key: list[str], sizes: int = 10, folds: int = 5,
                   **kw) -> DataFrame:
    """(share, train_rows, train_mean, train_std, val_mean, val_std) for ``sizes`` shares from 0.1 to 1 of the training folds.

    Scores are accuracy or R2, as the share's model has them on its own training rows and on the held-out fold.
    """
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    judge = (MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy") if task == "classification"
             else RegressionEvaluator(labelCol=label, metricName="r2"))
    data = nested(fold_column(df, key, folds), key).select("fold", "cell", label, *features).persist()
    rows = []
    try:
        for i in range(sizes):
            share = 0.1 + 0.9 * i / max(sizes - 1, 1)
            for f in range(folds):
                train = data.where((F.col("fold") != f) & (F.col("cell") < round(share * CELLS)))
                held = data.where(F.col("fold") == f)
                model = fit(train, features, label, name, task, **kw)
                rows.append((round(share, 4), f, train.count(), float(judge.evaluate(model.transform(train))), float(judge.evaluate(model.transform(held)))))
    finally:
        data.unpersist()
    out = df.sparkSession.createDataFrame(rows, "share double, fold int, n long, train double, val double")  # sizes x folds rows
    return out.groupBy("share").agg(F.sum("n").alias("train_rows"), rnd(F.avg("train"), 4).alias("train_mean"), rnd(F.stddev_pop("train"), 4).alias("train_std"),
                                    rnd(F.avg("val"), 4).alias("val_mean"), rnd(F.stddev_pop("val"), 4).alias("val_std"))
