"""Model training, selection and scoring on MLlib (data-parallel estimators).

Training frames are assembled by projections; splits are deterministic hash buckets
of a row key; every estimator is an MLlib ``Pipeline`` fitted on the cluster.
"""

from __future__ import annotations

from functools import reduce
from itertools import batched
from math import prod

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.stats import as_double, numeric_columns, rnd, safe_corr, string_columns
from . import binned


# ---------------------------------------------------------------- frames and splits
def training_frame(df: DataFrame, target: str, max_cardinality: int = CONFIG.one_hot_hard_cap) -> DataFrame:
    """M1: dates -> year/month/day/dayofweek/epoch, text -> one-hot (drop first; > cap rejected),
    other non-numeric dropped, numeric nulls -> 0. The target column is kept as is."""
    from .encode import one_hot
    from .features import date_numeric
    from ..functions.stats import datetime_columns
    dates = [c for c in datetime_columns(df) if c != target]
    out = date_numeric(df, dates) if dates else df
    txt = [c for c in string_columns(out) if c != target]
    from .profile import distinct_counts
    nd = {r.column_name: r.n_distinct for r in distinct_counts(out, txt).collect()} if txt else {}
    too_many = [c for c in txt if nd[c] > max_cardinality]
    if too_many:
        raise ValueError(f"cardinality above {max_cardinality}: {too_many}")
    out = one_hot(out, txt, drop_first=True, max_cardinality=max_cardinality) if txt else out
    keep = [c for c in out.columns if c == target or c in numeric_columns(out) or
            out.schema[c].dataType.simpleString() == "boolean"]
    return out.select(*[F.col(c) if c == target else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                        for c in keep])


def hash_split(df: DataFrame, key: list[str], test: float = CONFIG.test_size, val: float = CONFIG.validation_size,
               seed: int = CONFIG.seed) -> DataFrame:
    """M2: split label by a seeded hash bucket of the key (train / validation / test = 70 / 10 / 20)."""
    b = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1000))
    t_hi = int(round(test * 1000))
    v_hi = t_hi + int(round(val * 1000))
    return df.withColumn("split", F.when(b < t_hi, "test").when(b < v_hi, "validation").otherwise("train"))


def fold_column(df: DataFrame, key: list[str], k: int = CONFIG.cv_folds, seed: int = CONFIG.seed) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), *key), F.lit(k)).cast("int"))


def assemble(features: list[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep")


# ---------------------------------------------------------------- estimators
def estimator(name: str, task: str, label: str = "label", features: str = "features", seed: int = CONFIG.seed, **kw):
    """MLlib estimator by the reference's model names."""
    from pyspark.ml import classification as C
    from pyspark.ml import clustering as K
    from pyspark.ml import regression as Rg
    common = dict(labelCol=label, featuresCol=features)
    if task == "classification":
        table = {
            "logistic_regression": lambda: C.LogisticRegression(maxIter=kw.get("maxIter", 50), **common),
            "decision_tree": lambda: C.DecisionTreeClassifier(maxDepth=10, seed=seed, **common),
            "random_forest": lambda: C.RandomForestClassifier(numTrees=kw.get("numTrees", 100), seed=seed, **common),
            "gradient_boosting": lambda: C.GBTClassifier(maxIter=kw.get("maxIter", 20), seed=seed, **common),
            "svm": lambda: C.LinearSVC(maxIter=kw.get("maxIter", 50), **common),
            "neural_network": lambda: C.MultilayerPerceptronClassifier(layers=kw["layers"], seed=seed, maxIter=100, **common),
            "naive_bayes": lambda: C.NaiveBayes(**common),
        }
    elif task == "regression":
        table = {
            "linear_regression": lambda: Rg.LinearRegression(solver="normal", **common),
            "decision_tree": lambda: Rg.DecisionTreeRegressor(maxDepth=10, seed=seed, **common),
            "random_forest": lambda: Rg.RandomForestRegressor(numTrees=kw.get("numTrees", 100), seed=seed, **common),
            "gradient_boosting": lambda: Rg.GBTRegressor(maxIter=kw.get("maxIter", 20), seed=seed, **common),
            "svm": lambda: Rg.LinearRegression(loss="huber", maxIter=50, **common),
            "neural_network": lambda: Rg.FMRegressor(seed=seed, **common),
        }
    else:
        table = {
            "kmeans": lambda: K.KMeans(k=kw.get("k", 8), seed=seed, featuresCol=features),
            "hierarchical": lambda: K.BisectingKMeans(k=kw.get("k", 8), seed=seed, featuresCol=features),
        }
    if name not in table:
        raise ValueError(f"unknown model {name!r} for {task}")
    return table[name]()


def fit(df: DataFrame, features: list[str], label: str | None, name: str, task: str, **kw):
    """Fit ``assemble + estimator`` as one Pipeline."""
    stages = [assemble(features), estimator(name, task, label or "label", **kw)]
    return Pipeline(stages=stages).fit(df)


def train_many(df: DataFrame, features: list[str], label: str, task: str, names: list[str],
               metric: str = "f1", **kw) -> DataFrame:
    """Fit several models on the cached train split, score the test split, one row per model.

    Tree regressors are fitted on sums of the training rows by cell of their bins (see ``binned``)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    data = df.select(*features, label, "split").persist()  # nothing that no model reads is held
    in_cells, cells = [], None
    try:
        train, test = data.where(F.col("split") != "test"), data.where(F.col("split") == "test")
        if task == "regression":
            in_cells, cells = tree_cells(train, features, label, names, **kw)
        rows = []
        for n in names:
            if n in in_cells:
                pred = cells.predict(estimator(n, task, **kw), test)
            else:
                pred = fit(train, features, label, n, task, **kw).transform(test)
            if task == "classification":
                ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)
            else:
                ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName=metric)
            rows.append((n, float(ev.evaluate(pred))))
    finally:
        if cells is not None:
            cells.close()
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, score double")


def tree_cells(train: DataFrame, features: list[str], label: str, names: list[str], **kw) -> tuple[list[str], binned.Cells | None]:
    """Those of ``names`` that are tree regressors for which there are enough rows a cell, and the sums by cell that they are fitted on."""
    models = {n: estimator(n, "regression", **kw) for n in names if n in binned.LEAST}
    rows = train.count() if models and binned.plain(train, features) else 0
    if not rows:
        return [], None
    first = next(iter(models.values()))
    cuts = binned.borders(train, features, rows, first.getSeed(), first.getMaxBins())
    size = prod(len(c) + 1 for c in cuts)
    chosen = [n for n in models if size <= min(binned.MOST_CELLS, rows // binned.LEAST[n])]
    forest = models["random_forest"] if "random_forest" in chosen else None
    draws = dict(trees=forest.getNumTrees(), mean=forest.getSubsamplingRate()) if forest else {}
    return chosen, binned.Cells(train, features, label, cuts, first.getSeed(), **draws) if chosen else None


def cluster_many(df: DataFrame, features: list[str], names: list[str] = ("kmeans", "hierarchical"), ks: list[int] = (4, 8)) -> DataFrame:
    """M13, clustering: (model, k, silhouette, n_clusters) of each model and number of clusters; squared Euclidean silhouette, from
    sums for each cluster (no pairs of rows)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    data = df.persist()
    try:
        rows = []
        for n in names:
            for k in ks:
                out = fit(data, features, None, n, "clustering", k=k).transform(data)
                found = out.select("prediction").distinct().count()
                score = float(ClusteringEvaluator().evaluate(out)) if found > 1 else None
                rows.append((n, k, score, found))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, k int, silhouette double, n_clusters long")


def cross_validate(df: DataFrame, features: list[str], label: str, name: str, task: str, k: int = 5,
                   key: list[str] | None = None, **kw) -> DataFrame:
    """K folds from a hash of the key; mean and std of the test metric."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    data = fold_column(df, key or [c for c in df.columns if c != label], k).persist()
    scores = []
    try:
        for f in range(k):
            model = fit(data.where(F.col("fold") != f), features, label, name, task, **kw)
            pred = model.transform(data.where(F.col("fold") == f))
            ev = (MulticlassClassificationEvaluator(labelCol=label, metricName="f1") if task == "classification"
                  else RegressionEvaluator(labelCol=label, metricName="rmse"))
            scores.append((f, float(ev.evaluate(pred))))
    finally:
        data.unpersist()
    s = df.sparkSession.createDataFrame(scores, "fold int, score double")
    return s.agg(F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"), F.count(F.lit(1)).alias("folds"))


def grid_search(df: DataFrame, features: list[str], label: str, task: str, name: str, grid: dict,
                k: int = 3, parallelism: int = 2, sample_grid: int | None = None, seed: int = CONFIG.seed) -> DataFrame:
    """CrossValidator over a parameter grid (or a seeded sample of it); ranked results."""
    import random
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    est = estimator(name, task, label)
    b = ParamGridBuilder()
    for p, vals in grid.items():
        b = b.addGrid(est.getParam(p), vals)
    maps = b.build()
    if sample_grid and sample_grid < len(maps):
        maps = random.Random(seed).sample(maps, sample_grid)
    ev = (MulticlassClassificationEvaluator(labelCol=label, metricName="f1") if task == "classification"
          else RegressionEvaluator(labelCol=label, metricName="rmse"))
    cv = CrossValidator(estimator=Pipeline(stages=[assemble(features), est]), estimatorParamMaps=maps, evaluator=ev,
                        numFolds=k, parallelism=parallelism, seed=seed)
    data = df.select(*features, label).persist()  # every fold and fit reads it: what made it (joins) runs once
    try:
        model = cv.fit(data)
    finally:
        data.unpersist()
    rows = [(", ".join(f"{p.name}={v}" for p, v in m.items()), float(s)) for m, s in zip(maps, model.avgMetrics)]
    out = df.sparkSession.createDataFrame(rows, "params string, mean_score double")
    o = F.desc("mean_score") if ev.isLargerBetter() else F.asc("mean_score")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(o, "params")))


def feature_importance(model, features: list[str], spark) -> DataFrame:
    """Tree importances or mean |coefficient| per feature."""
    m = model.stages[-1]
    if hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray().tolist()
    elif hasattr(m, "coefficientMatrix"):
        cm = m.coefficientMatrix.toArray()
        vals = [float(abs(cm[:, j]).mean()) for j in range(cm.shape[1])]
    else:
        vals = [abs(float(v)) for v in m.coefficients.toArray()]
    return spark.createDataFrame(list(zip(features, vals)), "feature string, importance double")


def infer_task(df: DataFrame, columns: list[str] | None = None, max_classes: int = 20) -> DataFrame:
    """Numeric with > 20 distinct values -> regression, otherwise classification."""
    from .profile import distinct_counts
    cols = columns or df.columns
    num = set(numeric_columns(df))
    nd = distinct_counts(df, cols)
    return nd.select("column_name", "n_distinct",
                     F.when(F.col("column_name").isin(list(num) or [""]) & (F.col("n_distinct") > max_classes), "regression")
                     .otherwise("classification").alias("task"))


# ---------------------------------------------------------------- reduction
def pca(df: DataFrame, columns: list[str], k: int | None = None, variance: float = CONFIG.pca_variance):
    """Centred PCA (nulls as 0); k fixed or the fewest components reaching the variance share.

    Returns (scores DataFrame with pc_1..pc_k, explained-variance DataFrame).
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    means = df.agg(*[F.avg(F.coalesce(as_double(c), F.lit(0.0))).alias(c) for c in columns]).first()
    centred = df.select("*", *[(F.coalesce(as_double(c), F.lit(0.0)) - F.lit(means[c])).alias(f"_c_{c}") for c in columns])
    vec = assemble([f"_c_{c}" for c in columns], "_x").transform(centred)
    full = PCA(k=len(columns), inputCol="_x", outputCol="_pcs").fit(vec)
    ev = full.explainedVariance.toArray().tolist()
    if k is None:
        acc, k = 0.0, len(ev)
        for i, v in enumerate(ev):
            acc += v
            if acc >= variance - 1e-12:
                k = i + 1
                break
    scores = full.transform(vec).select(*df.columns, *[vector_to_array("_pcs")[i].alias(f"pc_{i + 1}") for i in range(k)])
    cum = [sum(ev[: i + 1]) for i in range(len(ev))]
    var = df.sparkSession.createDataFrame([(i + 1, ev[i], cum[i], i < k) for i in range(len(ev))],
                                          "component int, explained_variance double, cumulative double, selected boolean")
    return scores, var


def variance_filter(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.0) -> DataFrame:
    """Population variance (nulls as 0) per column and whether it passes (> threshold)."""
    from .profile import long_agg
    cols = columns or numeric_columns(df)
    out = long_agg(df, {c: {"variance": F.var_pop(F.coalesce(as_double(c), F.lit(0.0)))} for c in cols})
    return out.select("column_name", rnd("variance", 4).alias("variance"), (F.col("variance") > threshold).alias("keep"))


def corr_filter(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.95) -> DataFrame:
    """D3: drop a column when |r| with any earlier column exceeds the threshold (p^2 numbers on the driver)."""
    cols = columns or numeric_columns(df)
    pairs = [(i, j) for j in range(len(cols)) for i in range(j)]
    row = df.agg(*[safe_corr(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in pairs]).first() if pairs else {}
    rows = []
    for j, c in enumerate(cols):
        mx = max([abs(row[f"r{i}_{j}"]) for i in range(j) if row[f"r{i}_{j}"] is not None] or [0.0])
        rows.append((c, j, mx > threshold))
    return df.sparkSession.createDataFrame(rows, "column_name string, position int, dropped boolean")


def importance_select(df: DataFrame, features: list[str], label: str, task: str, top_k: int | None = None) -> DataFrame:
    """Random-forest importances (50 trees), top k (default half)."""
    model = fit(df, features, label, "random_forest", task, numTrees=50)
    imp = feature_importance(model, features, df.sparkSession)
    k = top_k or max(len(features) // 2, 1)
    return imp.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))) \
        .withColumn("selected", F.col("rank") <= k)


# ---------------------------------------------------------------- vectors
def cosine_topk(items: DataFrame, query: DataFrame, key: str, vec: str, k: int = 10,
                max_queries: int = 1000) -> DataFrame:
    """Cosine similarity of every item to each query vector, top k per query.

    The query set may have any size: ``max_queries`` vectors at a time are read and sent to the
    tasks, which go through all items and keep the best k for each query, so no pair is written
    or shuffled. Top-k per query over the tasks' rows is a salted top-k. A vector that is null, of
    another length than the query or of norm 0 has similarity null, which ranks last.
    """
    from ..functions.topk import top_k_per_group
    blocks = batched(query.select(key, vec).toLocalIterator(), max_queries)
    id_type = query.schema[key].dataType
    tops = [_block_topk(items, list(rows), id_type, key, vec, k) for rows in blocks]
    long = union_all(tops or [_block_topk(items.limit(0), [], id_type, key, vec, k)])
    top = top_k_per_group(long, ["query_id"], [F.desc("similarity"), F.asc("item_id")], k, salt_cols=["item_id"])
    return top.select("query_id", "item_id", rnd("similarity", 4).alias("similarity"), "rank")


def _block_topk(items: DataFrame, queries: list, id_type, key: str, vec: str, k: int) -> DataFrame:
    """Rows (query_id, item_id, similarity): the best k of each task for each of ``queries``."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_type
    names = pa.array([r[0] for r in queries], to_arrow_type(id_type))
    sizes = {len(r[1]) for r in queries if r[1] is not None}
    matrices = []  # of each vector length: numbers of the queries, and their values
    for size in sorted(sizes):
        at = [i for i, r in enumerate(queries) if r[1] is not None and len(r[1]) == size]
        matrices.append((np.array(at), np.array([queries[i][1] for i in at], float).reshape(len(at), size)))
    shared = items.sparkSession.sparkContext.broadcast(matrices)

    def dot(x, y):  # sums in order, so that equal vectors have equal similarities wherever they are
        total = np.zeros((len(x), len(y)))
        for d in range(x.shape[1]):
            total += x[:, d, None] * y[None, :, d]
        return total

    def norms(x):
        return np.sqrt(sum((x[:, d] * x[:, d] for d in range(x.shape[1])), np.zeros(len(x))))

    def similarities(vectors):
        out = np.full((len(vectors), len(names)), -np.inf)
        lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        for at, values in shared.value:
            rows = np.flatnonzero(lengths == values.shape[1])
            x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), values.shape[1])
            with np.errstate(invalid="ignore", divide="ignore"):
                sim = dot(x, values) / (norms(x)[:, None] * norms(values)[None, :])
            out[np.ix_(rows, at)] = np.where(np.isfinite(sim), sim, -np.inf)
        return out

    def best(batches):
        top, kth = None, np.full(len(names), -np.inf)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sim = similarities(part.column(1))
                row, q = np.nonzero(sim >= kth)
                new = pa.table({"q": q, "item": part.column(0).take(pa.array(row)), "sim": sim[row, q]})
                top = new if top is None else pa.concat_tables([top, new])
                top = top.take(pc.sort_indices(top, sort_keys=[("q", "ascending"), ("sim", "descending"), ("item", "ascending")],
                                               null_placement="at_start"))
                q = top.column("q").to_numpy()
                place = np.arange(len(q)) - np.searchsorted(q, q)
                last = place == k - 1
                kth[q[last]] = top.column("sim").to_numpy()[last]
                top = top.filter(pa.array(place < k))
        if top is not None:
            sim = top.column("sim").combine_chunks()
            yield from pa.table({"query_id": names.take(top.column("q").combine_chunks()), "item_id": top.column("item"),
                                 "similarity": pc.if_else(pc.is_finite(sim), sim, None)}).combine_chunks().to_batches()

    of = items.schema[key].dataType.simpleString()
    return items.select(key, vec).mapInArrow(best, f"query_id {id_type.simpleString()}, item_id {of}, similarity double")


# ---------------------------------------------------------------- scoring and retraining
def batch_predict(model, df: DataFrame) -> DataFrame:
    """Predictions with confidence = max class probability when the model has probabilities."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("confidence", F.array_max(vector_to_array("probability")))
    return out.drop("features", "rawPrediction", "probability")


def retrain_prep(df: DataFrame, target: str | None = None) -> DataFrame:
    """Numeric medians for nulls, text -> sorted category codes with null -> -1."""
    from .clean import impute
    from .encode import label_encode
    num = [c for c in numeric_columns(df) if c != target]
    txt = [c for c in string_columns(df) if c != target]
    out = impute(df, "median", num)
    out = label_encode(out, txt)
    return out.select(*[F.coalesce(F.col(c), F.lit(-1)).alias(c) if c in txt else F.col(c) for c in out.columns])


def promotion_decision(new: DataFrame, production: DataFrame, metric: str, threshold: float = 0.0) -> DataFrame:
    """Promote when the new metric beats production by more than the threshold, or nothing is in production."""
    n = new.where(F.col("metric") == metric).select(F.col("value").alias("new_value"))
    p = production.where(F.col("metric") == metric).select(F.col("value").alias("production_value"))
    from .quality import merge_one_row
    m = merge_one_row([n, p])
    delta = F.col("new_value") - F.col("production_value")
    return m.select("new_value", "production_value", rnd(delta, 4).alias("improvement"),
                    (F.col("production_value").isNull() | (delta > threshold)).alias("promote"))


def union_all(frames):
    return reduce(DataFrame.unionByName, frames)
