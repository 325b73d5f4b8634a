"""MLlib queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ml as M
from .registry import query
from .sqlgen import union_all
from .tables import cte, derived, table

KEY = ["o_orderkey"]
FEAT_NUM = ["o_totalprice", "c_acctbal", "c_nationkey"]


def _clf(spark, sf):
    """Order features with a binary label (status F) and a deterministic split."""
    df = derived(spark, sf, "order_features").withColumn("label", (F.col("o_orderstatus") == "F").cast("double"))
    df = df.withColumn("month", F.month("o_orderdate").cast("double"))
    return M.hash_split(df, KEY)


FEATS = FEAT_NUM + ["month"]


@query("training_frame", sql=cte("order_features") + """
SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
       CAST(year(o_orderdate) AS DOUBLE) AS o_orderdate_year, CAST(month(o_orderdate) AS DOUBLE) AS o_orderdate_month,
       CAST(day(o_orderdate) AS DOUBLE) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS o_orderdate_dayofweek,
       epoch(o_orderdate) AS o_orderdate_ordinal,
       CAST(o_orderpriority = '2-HIGH' AS DOUBLE) AS "o_orderpriority_2-HIGH",
       CAST(o_orderpriority = '3-MEDIUM' AS DOUBLE) AS "o_orderpriority_3-MEDIUM",
       CAST(o_orderpriority = '4-NOT SPECIFIED' AS DOUBLE) AS "o_orderpriority_4-NOT SPECIFIED",
       CAST(o_orderpriority = '5-LOW' AS DOUBLE) AS "o_orderpriority_5-LOW",
       CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS c_mktsegment_BUILDING,
       CAST(c_mktsegment = 'FURNITURE' AS DOUBLE) AS c_mktsegment_FURNITURE,
       CAST(c_mktsegment = 'HOUSEHOLD' AS DOUBLE) AS c_mktsegment_HOUSEHOLD,
       CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS c_mktsegment_MACHINERY,
       o_orderstatus
FROM order_features""")
def training_frame(spark, sf):
    df = derived(spark, sf, "order_features")
    return M.training_frame(df, "o_orderstatus").withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@query("split_sizes")
def split_sizes(spark, sf):
    return _clf(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("lin_reg_fit", sql=cte("lineitem_metrics") + """
SELECT round(regr_slope(revenue, l_extendedprice), 4) AS slope, round(regr_intercept(revenue, l_extendedprice), 4) AS intercept
FROM lineitem_metrics""")
def lin_reg_fit(spark, sf):
    df = derived(spark, sf, "lineitem_metrics")
    m = M.fit(df, ["l_extendedprice"], "revenue", "linear_regression", "regression").stages[-1]
    out = spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double")
    return out.select(*[(F.round(F.col(c) * 1e4, 0) / 1e4).alias(c) for c in ("slope", "intercept")])


def _fit_score(name, **kw):
    def run(spark, sf):
        df = _clf(spark, sf).cache()
        model = M.fit(df.where(F.col("split") == "train"), FEATS, "label", name, "classification", **kw)
        return M.batch_predict(model, df.where(F.col("split") == "test")).select("o_orderkey", "label", "prediction")
    return run


for _k, _n, _kw in [("log_reg", "logistic_regression", {}), ("tree_fit", "decision_tree", {}),
                    ("forest_fit", "random_forest", {"numTrees": 20}), ("gbt_fit", "gradient_boosting", {"maxIter": 10}),
                    ("svc_fit", "svm", {}), ("mlp_fit", "neural_network", {"layers": [4, 8, 2]})]:
    query(_k)(_fit_score(_n, **_kw))


@query("regression_models")
def regression_models(spark, sf):
    """R2 of each regression model on the held-out rows."""
    df = M.hash_split(derived(spark, sf, "lineitem_metrics").withColumn("row", F.xxhash64("l_extendedprice", "l_quantity", "l_tax", "l_discount")), ["row"])
    return M.train_many(df, ["l_extendedprice", "l_discount", "l_tax"], "revenue", "regression",
                        ["linear_regression", "decision_tree", "random_forest", "gradient_boosting"], metric="r2", numTrees=10, maxIter=10)


@query("cluster_models")
def cluster_models(spark, sf):
    df = derived(spark, sf, "order_features").select(F.col("o_totalprice").cast("double"), F.col("c_acctbal").cast("double"))
    scaled = df.select((F.col("o_totalprice") / 1e5).alias("a"), (F.col("c_acctbal") / 1e3).alias("b"))
    return M.cluster_many(scaled, ["a", "b"])


@query("text_classifiers")
def text_classifiers(spark, sf):
    from ..operators.text_models import compare_text_classifiers
    return compare_text_classifiers(table(spark, sf, "documents"), table(spark, sf, "labels"),
                                    ["logistic_regression", "naive_bayes", "random_forest", "gradient_boosting", "svm"])


@query("batch_predict")
def batch_predict(spark, sf):
    df = _clf(spark, sf)
    model = M.fit(df.where(F.col("split") == "train"), FEATS, "label", "logistic_regression", "classification")
    return M.batch_predict(model, df).select("o_orderkey", "prediction", "confidence")


@query("train_many")
def train_many(spark, sf):
    return M.train_many(_clf(spark, sf), FEATS, "label", "classification",
                        ["logistic_regression", "decision_tree", "random_forest"], numTrees=20)


@query("cross_validate")
def cross_validate(spark, sf):
    return M.cross_validate(_clf(spark, sf), FEATS, "label", "logistic_regression", "classification", k=3, key=KEY)


@query("grid_search")
def grid_search(spark, sf):
    return M.grid_search(_clf(spark, sf), FEATS, "label", "classification", "logistic_regression",
                         {"regParam": [0.0, 0.1], "elasticNetParam": [0.0, 0.5]}, k=3)


@query("random_search")
def random_search(spark, sf):
    return M.grid_search(_clf(spark, sf), FEATS, "label", "classification", "logistic_regression",
                         {"regParam": [0.0, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]}, k=3, sample_grid=4)


@query("feature_importance")
def feature_importance(spark, sf):
    df = _clf(spark, sf)
    model = M.fit(df, FEATS, "label", "random_forest", "classification", numTrees=20)
    return M.feature_importance(model, FEATS, spark)


@query("importance_select")
def importance_select(spark, sf):
    return M.importance_select(_clf(spark, sf), FEATS, "label", "classification")


@query("infer_task", sql=union_all([
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, CASE WHEN {num} AND count(DISTINCT {c}) > 20 "
    f"THEN 'regression' ELSE 'classification' END AS task FROM orders"
    for c, num in [("o_orderkey", "true"), ("o_custkey", "true"), ("o_orderstatus", "false"),
                   ("o_totalprice", "true"), ("o_orderpriority", "false")]]))
def infer_task(spark, sf):
    return M.infer_task(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                          "o_orderpriority"))


def _emb_cols(spark, sf):
    e = table(spark, sf, "embeddings")
    return e, e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])


@query("kmeans")
def kmeans(spark, sf):
    _, w = _emb_cols(spark, sf)
    m = M.fit(w, [f"e{i}" for i in range(64)], None, "kmeans", "clustering", k=10)
    return m.transform(w).select("vec_id", "prediction")


@query("hier_cluster")
def hier_cluster(spark, sf):
    _, w = _emb_cols(spark, sf)
    m = M.fit(w, [f"e{i}" for i in range(64)], None, "hierarchical", "clustering", k=10)
    return m.transform(w).select("vec_id", "prediction")


@query("pca_variance")
def pca_variance(spark, sf):
    _, w = _emb_cols(spark, sf)
    return M.pca(w, [f"e{i}" for i in range(64)], variance=0.95)[1]


@query("pca_scores")
def pca_scores(spark, sf):
    _, w = _emb_cols(spark, sf)
    return M.pca(w, [f"e{i}" for i in range(64)], k=5)[0].select("vec_id", *[f"pc_{i}" for i in range(1, 6)])


@query("embedding_clusters")
def embedding_clusters(spark, sf):
    from ..operators.encode import scale
    _, w = _emb_cols(spark, sf)
    cols = [f"e{i}" for i in range(64)]
    scores, _ = M.pca(scale(w, cols, "standard"), cols, k=10)
    pcs = [f"pc_{i}" for i in range(1, 11)]
    m = M.fit(scores, pcs, None, "kmeans", "clustering", k=10)
    return m.transform(scores).select("vec_id", "label", "prediction")


@query("variance_filter", sql=cte("lineitem_metrics") + union_all([
    f"SELECT '{c}' AS column_name, round(var_pop(coalesce({c}, 0.0)), 4) AS variance, var_pop(coalesce({c}, 0.0)) > 0.01 AS keep "
    f"FROM lineitem_metrics" for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "revenue"]]))
def variance_filter(spark, sf):
    return M.variance_filter(derived(spark, sf, "lineitem_metrics"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax",
                                                                      "revenue"], 0.01)


_CF = ["l_quantity", "l_extendedprice", "l_discount", "revenue", "charge", "unit_price"]


def _corr_filter_sql():
    from .sqlgen import corr_sql
    parts = []
    for j, c in enumerate(_CF):
        if j == 0:
            parts.append(f"SELECT '{c}' AS column_name, 0 AS position, false AS dropped")
        else:
            mx = "greatest(" + ", ".join(f"coalesce(abs({corr_sql(_CF[i], c)}), 0.0)" for i in range(j)) + ")" if j > 1 else \
                f"coalesce(abs({corr_sql(_CF[0], c)}), 0.0)"
            parts.append(f"SELECT '{c}', {j}, {mx} > 0.95 FROM lineitem_metrics")
    return cte("lineitem_metrics") + union_all(parts)


@query("corr_filter", sql=_corr_filter_sql())
def corr_filter(spark, sf):
    return M.corr_filter(derived(spark, sf, "lineitem_metrics"), _CF, 0.95)


@query("embedding_topk", sql="""
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id IN (0, 1)),
s AS (SELECT q.query_id, e.vec_id AS item_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), q.qv) /
             (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(q.qv, q.qv))) AS sim
      FROM embeddings e, q)
SELECT query_id, item_id, round(sim, 4) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM s) WHERE rank <= 10""")
def embedding_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    return M.cosine_topk(e, e.where(F.col("vec_id").isin(0, 1)), "vec_id", "embedding", 10)


@query("embedding_topk_all", sql="""
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, e.vec_id AS item_id, list_dot_product(CAST(e.embedding AS DOUBLE[]), q.qv) /
             (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(q.qv, q.qv))) AS sim
      FROM embeddings e, q)
SELECT query_id, item_id, round(sim, 4) AS similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM s) WHERE rank <= 10""")
def embedding_topk_all(spark, sf):
    """The whole query set: each row whose id is divisible by 20."""
    e = table(spark, sf, "embeddings")
    return M.cosine_topk(e, e.where(F.col("vec_id") % 20 == 0), "vec_id", "embedding", 10)


@query("retrain_prep", sql=cte("lineitem_gaps") + """
, fr AS (SELECT l_returnflag AS v, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS code
         FROM (SELECT DISTINCT l_returnflag FROM lineitem_gaps WHERE l_returnflag IS NOT NULL)),
ls AS (SELECT l_linestatus AS v, dense_rank() OVER (ORDER BY l_linestatus) - 1 AS code
       FROM (SELECT DISTINCT l_linestatus FROM lineitem_gaps WHERE l_linestatus IS NOT NULL))
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity, 4) AS l_quantity,
       round(coalesce(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM lineitem_gaps)), 4) AS l_extendedprice,
       round(coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM lineitem_gaps)), 4) AS l_discount,
       round(coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM lineitem_gaps)), 4) AS l_tax,
       CAST(coalesce(fr.code, -1) AS BIGINT) AS l_returnflag, CAST(coalesce(ls.code, -1) AS BIGINT) AS l_linestatus, l_shipdate
FROM lineitem_gaps g LEFT JOIN fr ON g.l_returnflag = fr.v LEFT JOIN ls ON g.l_linestatus = ls.v""")
def retrain_prep(spark, sf):
    from .common import rounded
    out = M.retrain_prep(derived(spark, sf, "lineitem_gaps").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"))
    out = out.select(*[F.col(c).cast("double").alias(c) if c in ("l_quantity",) else F.col(c) for c in out.columns])
    return rounded(out.select(*[F.col(c) for c in out.columns]))


def _model_metrics(t):
    return f"""SELECT 'f1' AS metric, 2.0 * count(*) FILTER (WHERE label = 1 AND score >= {t}) /
        (2 * count(*) FILTER (WHERE label = 1 AND score >= {t}) + count(*) FILTER (WHERE label = 0 AND score >= {t})
         + count(*) FILTER (WHERE label = 1 AND score < {t})) AS value FROM scored_orders"""


@query("promotion_decision", sql=cte("scored_orders") + f"""
, n AS ({_model_metrics(0.4)}), p AS ({_model_metrics(0.5)})
SELECT round(n.value, 4) AS new_value, round(p.value, 4) AS production_value, round(n.value - p.value, 4) AS improvement,
       (p.value IS NULL OR n.value - p.value > 0.0) AS promote FROM n, p""")
def promotion_decision(spark, sf):
    s = derived(spark, sf, "scored_orders")

    # compare unrounded f1 of both models
    from ..operators.evaluate import per_class

    def raw(t):
        pc = per_class(s.withColumn("p", (F.col("score") >= t).cast("int")), "label", "p")
        return pc.where(F.col("class") == "1").select(F.lit("f1").alias("metric"), F.col("f1").alias("value"))
    out = M.promotion_decision(raw(0.4), raw(0.5), "f1", 0.0)
    return out.select((F.round(F.col("new_value") * 1e4, 0) / 1e4).alias("new_value"),
                      (F.round(F.col("production_value") * 1e4, 0) / 1e4).alias("production_value"), "improvement", "promote")


@query("recon_error")
def recon_error(spark, sf):
    """Reconstruction error through k = max(2, p // 3) principal components; top (1 - c) flagged."""
    _, w = _emb_cols(spark, sf)
    cols = [f"e{i}" for i in range(64)]
    from ..operators.anomaly import pca_reconstruction_flags
    return pca_reconstruction_flags(w, cols, "vec_id", contamination=0.05)


@query("text_classify")
def text_classify(spark, sf):
    from ..operators.text_models import text_classifier
    return text_classifier(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("lda_topics")
def lda_topics(spark, sf):
    from ..operators.text_models import lda_topics as lda
    return lda(table(spark, sf, "documents"), k=5)[0]


@query("topic_distribution")
def topic_distribution(spark, sf):
    from ..operators.text_models import topic_distribution as distribution
    return distribution(table(spark, sf, "documents"), k=5)
