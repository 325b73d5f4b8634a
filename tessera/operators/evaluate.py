"""Model evaluation as aggregations over (label, prediction[, score]) columns.

Classes are few, so per-class tables are small; everything per row is an
aggregate. Curves and AUC first collapse rows to one row per distinct score,
then use range-partitioned prefix sums (no single-partition window).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_prefix_sums
from ..functions.stats import as_double, rnd

EPS = 2.220446049250313e-16  # fixed value: float64 machine epsilon (MAPE floor)


def _classes(df: DataFrame, label: str, prediction: str, most: int = 1000) -> list:
    """Sorted class values appearing as label or prediction; more than ``most`` are an error (no class labels then)."""
    vals = (df.select(F.col(label).cast("string").alias("c")).union(df.select(F.col(prediction).cast("string")))
            .where(F.col("c").isNotNull()).distinct().limit(most + 1).collect())
    if len(vals) > most:
        raise ValueError(f"more than {most} distinct labels: is {label} a class label?")
    return sorted(r[0] for r in vals)


def per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, tp, fp, fn, support) for every class, from the counts of (label, prediction) pairs."""
    cells = (df.select(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p"))
             .groupBy("y", "p").agg(F.count(F.lit(1)).alias("n")))
    hit, both = F.col("y") == F.col("p"), F.col("y").isNotNull() & F.col("p").isNotNull()
    told = cells.where("y is not null").groupBy(F.col("y").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n"))).alias("tp"), F.sum(F.when(both & ~hit, F.col("n"))).alias("fn"))
    said = cells.where("p is not null").groupBy(F.col("p").alias("class")).agg(F.sum(F.when(both & ~hit, F.col("n"))).alias("fp"))
    t = told.join(said, "class", "full").select("class", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn", "support")])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return t.select("class", "tp", "fp", "fn", "support", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def clf_metrics(df: DataFrame, label: str, prediction: str, pos_label: str = "1") -> DataFrame:
    """Accuracy + precision/recall/F1 for the positive class (2 classes) or support-weighted."""
    pc = per_class(df, label, prediction)
    classes = _classes(df, label, prediction)
    n_acc = df.agg(F.count_if(F.col(label).cast("string") == F.col(prediction).cast("string")).alias("ok"),
                   F.count(F.lit(1)).alias("n"))
    if len(classes) <= 2 and pos_label in classes:
        m = pc.where(F.col("class") == pos_label).select("precision", "recall", "f1")
        avg = "binary"
    else:
        tot = F.sum("support")
        m = pc.agg(*[F.try_divide(F.sum(F.col(k) * F.col("support")), tot).alias(k) for k in ("precision", "recall", "f1")])
        avg = "weighted"
    from .quality import merge_one_row
    out = merge_one_row([n_acc.select((F.col("ok") / F.col("n")).alias("accuracy")), m])
    return out.select(*[rnd(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1")],
                      F.lit(avg).alias("average"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(actual, predicted, count) for every pair of classes, zero cells included."""
    classes = _classes(df, label, prediction)
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, p) for a in classes for p in classes], "actual string, predicted string")
    counts = (df.groupBy(F.col(label).cast("string").alias("actual"), F.col(prediction).cast("string").alias("predicted"))
              .agg(F.count(F.lit(1)).alias("count")))
    # the grid has (#classes)^2 rows: a bounded broadcast
    return counts.join(F.broadcast(grid), ["actual", "predicted"], "right").select(
        "actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def per_class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted average rows."""
    pc = per_class(df, label, prediction).select("class", "precision", "recall", "f1", "support")
    tot = F.sum("support")
    macro = pc.agg(F.lit("macro avg").alias("class"), *[F.avg(k).alias(k) for k in ("precision", "recall", "f1")],
                   tot.alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("class"),
                      *[F.try_divide(F.sum(F.col(k) * F.col("support")), tot).alias(k) for k in ("precision", "recall", "f1")],
                      tot.alias("support"))
    out = pc.unionByName(macro).unionByName(weighted)
    return out.select("class", *[rnd(k, 4).alias(k) for k in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def _score_groups(df: DataFrame, label: str, score: str, pos_label=1) -> DataFrame:
    return (df.where(F.col(score).isNotNull()).groupBy(as_double(score).alias("score"))
            .agg(F.count_if(F.col(label) == F.lit(pos_label)).alias("pos"),
                 F.count_if(F.col(label) != F.lit(pos_label)).alias("neg")))


def roc_auc(df: DataFrame, label: str, score: str, pos_label=1) -> DataFrame:
    """Binary ROC AUC by the rank-sum formula with tied scores given their average rank."""
    g = _score_groups(df, label, score, pos_label)
    cum = global_prefix_sums(g, [F.col("score").asc()], {"cnt": F.col("pos") + F.col("neg")})
    # average rank of a tie group = rows before it + (size + 1) / 2
    ranked = cum.select("pos", "neg", (F.col("cnt") - (F.col("pos") + F.col("neg")) +
                                       (F.col("pos") + F.col("neg") + 1) / 2.0).alias("avg_rank"))
    s = ranked.agg(F.sum(F.col("pos") * F.col("avg_rank")).alias("rsum"), F.sum("pos").alias("P"),
                   F.sum("neg").alias("N"))
    auc = F.try_divide(F.col("rsum") - F.col("P") * (F.col("P") + 1) / 2.0, (F.col("P") * F.col("N")).cast("double"))
    return s.select(rnd(auc, 4).alias("roc_auc"), F.col("P").alias("positives"), F.col("N").alias("negatives"))


def roc_curve(df: DataFrame, label: str, score: str, pos_label=1) -> DataFrame:
    """E5: (threshold, fpr, tpr) at every distinct score, highest threshold first."""
    g = _score_groups(df, label, score, pos_label)
    tot = g.agg(F.sum("pos"), F.sum("neg")).first()
    P, N = tot[0] or 0, tot[1] or 0
    cum = global_prefix_sums(g, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    return cum.select(F.col("score").alias("threshold"),
                      rnd(F.try_divide(F.col("fp").cast("double"), F.lit(float(N))), 4).alias("fpr"),
                      rnd(F.try_divide(F.col("tp").cast("double"), F.lit(float(P))), 4).alias("tpr"))


def pr_curve(df: DataFrame, label: str, score: str, pos_label=1) -> DataFrame:
    """(threshold, precision, recall) at every distinct score."""
    g = _score_groups(df, label, score, pos_label)
    P = g.agg(F.sum("pos")).first()[0] or 0
    cum = global_prefix_sums(g, [F.col("score").desc()], {"tp": F.col("pos"), "fp": F.col("neg")})
    return cum.select(F.col("score").alias("threshold"),
                      rnd(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), 4).alias("precision"),
                      rnd(F.try_divide(F.col("tp").cast("double"), F.lit(float(P))), 4).alias("recall"))


def reg_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """MAE, MSE, RMSE, R2, explained variance, residual mean / std (ddof 0)."""
    y, p = as_double(label), as_double(prediction)
    e = y - p
    s = df.where(y.isNotNull() & p.isNotNull()).agg(
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(y).alias("vy"),
        F.var_pop(e).alias("ve"), F.avg(e).alias("rm"), F.stddev_pop(e).alias("rs"))
    return s.select(rnd("mae", 4).alias("mae"), rnd("mse", 4).alias("mse"), rnd(F.sqrt("mse"), 4).alias("rmse"),
                    rnd(1 - F.try_divide(F.col("mse"), F.col("vy")), 4).alias("r2"),
                    rnd(1 - F.try_divide(F.col("ve"), F.col("vy")), 4).alias("explained_variance"),
                    rnd("rm", 4).alias("residual_mean"), rnd("rs", 4).alias("residual_std"))


def mape(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean |y - p| / max(|y|, eps)."""
    y, p = as_double(label), as_double(prediction)
    return df.agg(rnd(F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPS))), 4).alias("mape"))


def rank_models(metrics: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """Rank model rows by a metric (the metric table has one row per model)."""
    o = F.desc_nulls_last(metric) if higher_is_better else F.asc_nulls_last(metric)
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(o, "model")))


def anomaly_eval(df: DataFrame, label: str, flag: str) -> DataFrame:
    """Accuracy / precision / recall / F1 of anomaly flags against 0/1 labels."""
    x = df.select(F.col(label).cast("int").cast("string").alias("y"),
                  F.col(flag).cast("int").cast("string").alias("p"))
    return clf_metrics(x, "y", "p", "1")


def union_all(frames):
    return reduce(DataFrame.unionByName, frames)


def roc_auc_ovr(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """One-vs-rest ROC AUC of each class (its score column named by ``scores``) and their mean weighted by support."""
    parts = [roc_auc(df.withColumn("_one", (F.col(label) == F.lit(c)).cast("int")), "_one", s).select(
        F.lit(c).alias("class"), "roc_auc", F.col("positives").alias("support")) for c, s in scores.items()]
    from functools import reduce
    each = reduce(DataFrame.unionByName, parts)
    mean = each.agg(F.lit("__weighted__").alias("class"), rnd(F.try_divide(F.sum(F.col("roc_auc") * F.col("support")), F.sum("support")), 4).alias("roc_auc"),
                    F.sum("support").alias("support"))
    return each.unionByName(mean)


def davies_bouldin(df: DataFrame, features: list[str], cluster: str, most: int = 1000) -> DataFrame:
    """Mean over clusters of the worst (spread_i + spread_j) / distance of centroids.

    Two grouped aggregations give one row for each cluster; those (at most ``most``) are compared on the driver.
    """
    x = [as_double(c) for c in features]
    centres = df.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("_c")).agg(F.array(*[F.avg(e) for e in x]).alias("_m"))
    d2 = sum(((e - F.get("_m", F.lit(i))) ** 2 for i, e in enumerate(x)), F.lit(0.0))
    rows = df.join(centres, F.col(cluster) == F.col("_c")).groupBy("_c").agg(
        F.first("_m").alias("m"), F.avg(F.sqrt(d2)).alias("s")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} clusters")
    worst = [max(((a.s + b.s) / gap for b in rows if b is not a and (gap := sum((p - q) ** 2 for p, q in zip(a.m, b.m)) ** 0.5)), default=0.0) for a in rows]
    value = sum(worst) / len(worst) if len(worst) > 1 else None
    return df.sparkSession.createDataFrame([(len(rows), value)], "n_clusters long, davies_bouldin double").select("n_clusters", rnd("davies_bouldin", 4).alias("davies_bouldin"))
