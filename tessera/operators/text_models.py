"""Text models on MLlib: TF-IDF + classifier, LDA topics and document topic distribution."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import clean_tokens


def _classifier(model: str, seed: int):
    table = {"logistic_regression": lambda: LogisticRegression(maxIter=50), "naive_bayes": lambda: NaiveBayes(),
             "random_forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=8, seed=seed), "svm": lambda: LinearSVC(maxIter=30),
             "gradient_boosting": lambda: GBTClassifier(maxIter=10, maxDepth=4, seed=seed)}
    if model not in table:
        raise ValueError(f"unknown model {model!r}")
    return table[model]()


def _hashed(docs: DataFrame, labels: DataFrame, label: str, key: str, seed: int, buckets: list[int]) -> DataFrame:
    """(key, label, is_test, tf_<n> of each n of ``buckets``): hashed counts of the cleaned tokens of every labelled document."""
    d = docs.join(labels.select(key, F.col(label).cast("double").alias("label")), key) \
        .select(key, "label", clean_tokens(F.col("text")).alias("tokens"))
    d = d.withColumn("is_test", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(5)) == 0)
    for n in buckets:
        d = HashingTF(inputCol="tokens", outputCol=f"tf_{n}", numFeatures=n).transform(d)
    return d.drop("tokens")


def _weighted(d: DataFrame, buckets: int):
    return IDF(inputCol=f"tf_{buckets}", outputCol="features").fit(d.where(~F.col("is_test")))


def _predictions(d: DataFrame, idf, key: str, model: str, seed: int) -> DataFrame:
    fitted = _classifier(model, seed).fit(idf.transform(d.where(~F.col("is_test"))))
    return fitted.transform(idf.transform(d.where(F.col("is_test")))).select(key, "label", "prediction")


def text_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id",
                    seed: int = 42, model: str = "logistic_regression", buckets: int = 1 << 18) -> DataFrame:
    """Cleaned tokens -> hashed counts (``buckets``, no term is dropped) -> IDF -> classifier; hash split 80 / 20;
    per-document test predictions. Trees look at every bucket for a split: give them fewer."""
    d = _hashed(docs, labels, label, key, seed, [buckets]).persist()  # fits go over the counts, not the texts
    try:
        return _predictions(d, _weighted(d, buckets), key, model, seed)
    finally:
        d.unpersist()


@contextmanager
def _lda(docs: DataFrame, k: int, key: str, vocab_size: int, seed: int):
    """(count vectors, vocabulary, online LDA model). Texts are tokenised once, for vocabulary and vectors; the vectors are held meanwhile, as
    every iteration samples from all of them."""
    d = docs.select(key, clean_tokens(F.col("text")).alias("tokens")).persist(StorageLevel.DISK_ONLY)
    x = None
    try:
        cv = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=vocab_size).fit(d)
        x = cv.transform(d).select(key, "features").persist()
        yield x, cv.vocabulary, LDA(k=k, seed=seed, optimizer="online", maxIter=10).fit(x)
    finally:
        if x is not None:
            x.unpersist()
        d.unpersist()


def _dominant(model, x: DataFrame, key: str) -> DataFrame:
    dist = model.transform(x).select(key, vector_to_array("topicDistribution").alias("p"))
    dom = dist.select(key, (F.array_position(F.col("p"), F.array_max("p")) - 1).alias("topic"))
    return dom.groupBy("topic").agg(F.count(F.lit(1)).alias("n_documents"))


def lda_topics(docs: DataFrame, k: int = 5, key: str = "doc_id", vocab_size: int = 1 << 18, seed: int = 42,
               top_terms: int = 10):
    """Online LDA; (topic, rank, term, weight) and the documents of each dominant topic."""
    with _lda(docs, k, key, vocab_size, seed) as (x, vocab, model):
        topics = model.describeTopics(top_terms).collect()  # k x top_terms numbers: bounded by parameters
    rows = [(t.topic, r + 1, vocab[i], float(w)) for t in topics for r, (i, w) in enumerate(zip(t.termIndices, t.termWeights))]
    terms = docs.sparkSession.createDataFrame(rows, "topic int, rank int, term string, weight double")
    return terms, _dominant(model, x, key)


def topic_distribution(docs: DataFrame, k: int = 5, key: str = "doc_id", vocab_size: int = 1 << 18, seed: int = 42) -> DataFrame:
    """(topic, n_documents) by each document's dominant topic."""
    with _lda(docs, k, key, vocab_size, seed) as (x, _, model):
        found = _dominant(model, x, key)
        return docs.sparkSession.createDataFrame(found.collect(), found.schema)  # k rows at most


def compare_text_classifiers(docs: DataFrame, labels: DataFrame, models: list[str], label: str = "quality", key: str = "doc_id", seed: int = 42,
                             tree_buckets: int = 1 << 10) -> DataFrame:
    """(model, accuracy, precision, recall, f1; weighted by class) of each model on the same held-out documents."""
    from .evaluate import clf_metrics
    buckets = {m: tree_buckets if m in ("random_forest", "gradient_boosting") else 1 << 18 for m in models}
    d = _hashed(docs, labels, label, key, seed, sorted(set(buckets.values()))).persist()  # texts are tokenised once for all models
    rows = []
    try:
        weighted = {n: _weighted(d, n) for n in set(buckets.values())}
        for m in models:
            scored = _predictions(d, weighted[buckets[m]], key, m, seed)
            cast = scored.select(F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction")).persist()
            try:
                rows += [(m, *r) for r in clf_metrics(cast, "label", "prediction", pos_label="").select("accuracy", "precision", "recall", "f1").collect()]  # one row
            finally:
                cast.unpersist()
    finally:
        d.unpersist()
    return docs.sparkSession.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double")
