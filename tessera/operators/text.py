"""Text analytics over a (doc_id, text) relation.

Tokens are produced by JVM regex functions inside each row; corpus statistics
(term counts, document frequencies, TF-IDF, keywords) are grouped aggregates
whose partial aggregation collapses frequent terms on the map side. Only the
character offsets of regex entities need Python (``re.finditer`` in an Arrow
``pandas_udf``).
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import rnd, word_count
from ..session import ensure_checkpoint_dir
from ..sources.readers import scratch_path

# fixed values: basic English stop words (used when no language resources are installed)
STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "your", "yours", "yourself", "yourselves", "he", "him", "his",
    "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having",
    "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out",
    "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "both",
    "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "should", "now", "d", "ll", "m", "o",
    "re", "ve", "y",
]

# fixed values: regex entity patterns
ENTITY_PATTERNS = {
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "URL": r"https?://\S+|www\.\S+",
    "PHONE": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "DATE": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "MONEY": r"\$\d+(?:,\d{3})*(?:\.\d{2})?",
    "PERCENTAGE": r"\b\d+(?:\.\d+)?%",
}

WORD = r"[\p{L}\p{N}_]"          # Unicode word character (letters, digits, underscore)
TOKEN2 = WORD + "{2,}"            # words of two or more word characters
ALPHA2 = r"^[a-zA-Z]{2,}$"        # a whole word of >= 2 ASCII letters (word clouds, frequency keywords)


def _stop_array() -> Column:
    return F.array(*[F.lit(w) for w in STOPWORDS])


def drop_stopwords(tokens: Column) -> Column:
    # isin over literals compiles to a hash-set lookup (InSet), not a scan of the list per token
    return F.filter(tokens, lambda t: ~t.isin(STOPWORDS))


# ---------------------------------------------------------------- N1 / N2
def detect_text(df: DataFrame, min_words: float = 3, min_chars: float = 20) -> DataFrame:
    """String columns whose mean word count >= 3 or mean length >= 20 (non-null values)."""
    from .profile import long_agg
    from ..functions.stats import string_columns
    cols = string_columns(df)
    out = long_agg(df, {c: {"avg_words": F.avg(word_count(F.col(c))), "avg_chars": F.avg(F.char_length(F.col(c)))}
                        for c in cols})
    return (out.where((F.col("avg_words") >= min_words) | (F.col("avg_chars") >= min_chars))
            .select("column_name", rnd("avg_words", 2).alias("avg_words"), rnd("avg_chars", 2).alias("avg_chars")))


def clean_tokens(text: Column, lowercase=True, remove_urls=True, remove_html=True, remove_numbers=False,
                 remove_punctuation=True, remove_stopwords=True, min_length=2) -> Column:
    """The token array of one text (all JVM expressions)."""
    t = F.coalesce(text, F.lit(""))
    if lowercase:
        t = F.lower(t)
    if remove_urls:
        t = F.regexp_replace(t, r"http\S+|www\.\S+", "")
    if remove_html:
        t = F.regexp_replace(t, r"<[^>]+>", "")
    if remove_numbers:
        t = F.regexp_replace(t, r"\d+", "")
    if remove_punctuation:
        t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", "")
    toks = F.regexp_extract_all(t, F.lit(r"\S+"), 0)
    if remove_stopwords:
        toks = drop_stopwords(toks)
    if min_length > 1:
        toks = F.filter(toks, lambda x: F.char_length(x) >= min_length)
    return toks


def text_clean(df: DataFrame, text: str = "text", key: str = "doc_id", **opts) -> DataFrame:
    """Cleaned text and token counts before / after."""
    toks = clean_tokens(F.col(text), **opts)
    return df.select(key, F.array_join(toks, " ").alias("clean_text"),
                     word_count(F.coalesce(F.col(text), F.lit(""))).alias("n_tokens_before"),
                     F.size(toks).alias("n_tokens_after"))


def term_counts(df: DataFrame, text: str = "text", key: str = "doc_id", **opts) -> DataFrame:
    """(doc, token, tf): the relational bag of words of the cleaned tokens."""
    return (df.select(key, F.explode(clean_tokens(F.col(text), **opts)).alias("token"))
            .groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf")))


# ---------------------------------------------------------------- N4
def text_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Words / chars / sentences: mean, median, min, max, std (words)."""
    t = F.coalesce(F.col(text), F.lit(""))
    x = df.select(word_count(t).alias("w"), F.char_length(t).alias("c"),
                  F.regexp_count(t, F.lit(r"[.!?]+")).alias("s"), (t == "").alias("empty"))
    return x.agg(F.count(F.lit(1)).alias("total_documents"), F.count_if("empty").alias("empty_documents"),
                 rnd(F.avg("w"), 2).alias("words_mean"), rnd(F.percentile("w", 0.5), 2).alias("words_median"),
                 F.min("w").alias("words_min"), F.max("w").alias("words_max"), rnd(F.stddev_samp("w"), 2).alias("words_std"),
                 rnd(F.avg("c"), 1).alias("chars_mean"), rnd(F.percentile("c", 0.5), 1).alias("chars_median"),
                 F.min("c").alias("chars_min"), F.max("c").alias("chars_max"),
                 rnd(F.avg("s"), 2).alias("sentences_mean"), rnd(F.percentile("s", 0.5), 2).alias("sentences_median"))


# ---------------------------------------------------------------- N5 / N6
def alpha_word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, count) of lower-cased ASCII words of >= 2 letters, stop words removed."""
    # maximal runs of Unicode word characters that consist of ASCII letters only: the same
    # matches as a Unicode-aware \b[a-zA-Z]{2,}\b, written without word-boundary assertions
    runs = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD + "+"), 0)
    words = df.select(F.explode(runs).alias("word"))
    kept = words.where(F.col("word").rlike(ALPHA2) & ~F.col("word").isin(STOPWORDS))
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def word_cloud(df: DataFrame, text: str = "text", top_k: int = 100) -> DataFrame:
    """Top-k words with count and weight = count / top count (ties by word)."""
    top = alpha_word_counts(df, text).orderBy(F.desc("count"), "word").limit(top_k)
    mx = top.agg(F.max("count")).first()[0] or 1
    return top.select("word", "count", rnd(F.col("count") / F.lit(float(mx)), 4).alias("weight"))


def keywords_freq(df: DataFrame, text: str = "text", top_k: int = 20) -> DataFrame:
    """Top-k words by share of all (non-stop) words."""
    wc = alpha_word_counts(df, text)
    total = wc.agg(F.sum("count")).first()[0] or 1
    return (wc.orderBy(F.desc("count"), "word").limit(top_k)
            .select(F.col("word").alias("keyword"), rnd(F.col("count") / F.lit(float(total)), 6).alias("score"), "count"))


# ---------------------------------------------------------------- N7 / N8 / N9
#: Terms whose document frequencies are sent to the tasks, and the documents that choose them; any choice gives the same weights.
HOT_TERMS, HOT_DOCS = 200_000, 20_000


def _counted(tokens: DataFrame, key: str, ngram_max: int, repeated: bool) -> DataFrame:
    """(doc, term, tf, what else ``tokens`` has). Terms are counted in their row; only rows of repeated keys are added up by a shuffle."""
    rest = [f.name for f in tokens.schema.fields if f.name != "_toks"]

    def counted(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                toks = part.column("_toks")
                row, term = pc.list_parent_indices(toks), toks.flatten()
                rows, terms = [row], [term]
                for n in range(2, ngram_max + 1):
                    last = len(term) - n + 1
                    if last > 0:
                        same = pc.equal(row.slice(0, last), row.slice(n - 1))
                        rows.append(row.slice(0, last).filter(same))
                        terms.append(pc.binary_join_element_wise(*[term.slice(i, last).filter(same) for i in range(n)], " "))
                cells = pa.table({"row": pa.chunked_array(rows), "term": pa.chunked_array(terms)}).group_by(["row", "term"]).aggregate([([], "count_all")])
                at = cells.column("row")
                yield from pa.table({**{c: part.column(c).take(at.combine_chunks()) for c in rest}, "term": cells.column("term"),
                                     "tf": cells.column("count_all")}).combine_chunks().to_batches()

    kinds = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in rest)
    rows = tokens.mapInArrow(counted, f"{kinds}, term string, tf long")
    return rows.groupBy(*rest, "term").agg(F.sum("tf").alias("tf")) if repeated else rows


class _Weights:
    """TF-IDF of a corpus: tf (1 + ln tf if sublinear) x (ln((1 + n) / (1 + df)) + 1), before the L2 norm.

    Token arrays are written once (Parquet, one row a document); every pass counts its terms anew from them, so no table of term rows is
    written or moved. Rows of hot terms (frequent in some of the documents) get their exact document frequency from a broadcast
    table; only those of the other terms are shuffled by term, and counted there. Both together are all terms.
    """

    def __init__(self, df: DataFrame, text: str, key: str, ngram_max: int, sublinear: bool, hot: int, hot_docs: int):
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        path = scratch_path(spark, "tokens")
        df.select(key, drop_stopwords(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN2), 0)).alias("_toks")).write.parquet(path)
        self.tokens = spark.read.parquet(path)
        self.key, self.ngram_max, self.sublinear, self.n_docs = key, ngram_max, sublinear, self.tokens.count()
        self.repeated = bool(self.tokens.groupBy(key).count().where("count > 1").limit(1).count())
        self.terms = _counted(self.tokens, key, ngram_max, self.repeated)
        share = min(1.0, hot_docs / max(self.n_docs, 1))
        some = self.tokens if share == 1.0 else self.tokens.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
        named = (_counted(some, key, ngram_max, False).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
                 .orderBy(F.desc("n"), "term").limit(hot).select("term").checkpoint())
        # at most ``hot`` rows: a bounded broadcast
        self.hot = self.terms.join(F.broadcast(named), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")).checkpoint()

    def _weighed(self, rows: DataFrame) -> DataFrame:
        idf = F.log((1.0 + self.n_docs) / (1.0 + F.col("df"))) + 1.0
        tfw = (1.0 + F.log(F.col("tf").cast("double"))) if self.sublinear else F.col("tf").cast("double")
        return rows.withColumn("w", tfw * idf)

    def hot_rows(self, terms: DataFrame | None = None) -> DataFrame:
        return self._weighed((self.terms if terms is None else terms).join(F.broadcast(self.hot), "term"))

    def cold_rows(self) -> DataFrame:
        cold = self.terms.join(F.broadcast(self.hot.select("term")), "term", "left_anti")
        return self._weighed(cold.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term"))))  # groups of rare terms

    def norms(self) -> DataFrame:
        """(doc, nrm, cold_df), materialised; ``cold_df`` is the largest document frequency of the document's terms that are not hot."""
        squares = self.hot_rows().select(self.key, "w", F.lit(0).cast("long").alias("df")).unionByName(self.cold_rows().select(self.key, "w", "df"))
        norms = squares.groupBy(self.key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nrm"), F.max("df").alias("cold_df"))
        return norms.where(F.col(self.key).isNotNull()).checkpoint()

    def hot_weights(self, norms: DataFrame) -> DataFrame:
        """Rows of hot terms with their weight; the norm joins the documents before they are taken apart."""
        terms = _counted(self.tokens.join(norms.select(self.key, "nrm"), self.key), self.key, self.ngram_max, self.repeated)
        return self.hot_rows(terms).withColumn("weight", F.col("w") / F.col("nrm"))

    def cold_weights(self, norms: DataFrame, least_df: float = 0.0) -> DataFrame:
        return self.cold_rows().where(F.col("df") >= F.lit(least_df)).join(norms.select(self.key, "nrm"), self.key).withColumn("weight", F.col("w") / F.col("nrm"))


def tfidf_terms(df: DataFrame, text: str = "text", key: str = "doc_id", ngram_max: int = 1,
                sublinear: bool = True, hot: int = HOT_TERMS, hot_docs: int = HOT_DOCS) -> DataFrame:
    """(doc, term, weight): tf (1 + ln tf if sublinear) x (ln((1 + n) / (1 + df)) + 1), L2-normalised per doc.

    Tokens: lower-cased runs of >= 2 Unicode word characters, stop words removed;
    n-grams join consecutive kept tokens with a space.
    """
    weights = _Weights(df, text, key, ngram_max, sublinear, hot, hot_docs)
    norms = weights.norms()
    names = [key, "term", "tf", "weight"]
    return weights.hot_weights(norms).select(*names).unionByName(weights.cold_weights(norms).select(*names))


def keywords_tfidf(df: DataFrame, text: str = "text", key: str = "doc_id", top_k: int = 20,
                   ngram_max: int = 2, hot: int = HOT_TERMS, hot_docs: int = HOT_DOCS) -> DataFrame:
    """Terms with the highest mean TF-IDF over all documents (1- and 2-grams, sublinear tf).

    A normalised weight is 1 at most, so no term scores above df / n. Scores of hot terms give a floor; terms that are not hot
    are scored too unless even the most frequent of them stays below it.
    """
    weights = _Weights(df, text, key, ngram_max, True, hot, hot_docs)
    n_docs, norms = weights.n_docs, weights.norms()

    def best(rows):
        scores = rows.groupBy("term").agg((F.sum("weight") / F.lit(float(n_docs))).alias("score"))
        return scores.orderBy(F.desc("score"), "term").limit(top_k)
    top = best(weights.hot_weights(norms)).checkpoint()
    scored = top.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).first()
    floor = scored["floor"] * n_docs * (1 - 1e-9) if scored["n"] == top_k and top_k else 0.0
    if (norms.agg(F.max("cold_df")).first()[0] or 0) >= max(floor, 1):
        top = top.unionByName(best(weights.cold_weights(norms, floor)))
    return (top.orderBy(F.desc("score"), "term").limit(top_k)
            .select(F.col("term").alias("keyword"), rnd("score", 6).alias("score")))


def count_vectors(df: DataFrame, text: str = "text", key: str = "doc_id", vocab_size: int | None = None) -> DataFrame:
    """(doc, term, count) over the vocabulary (the ``vocab_size`` most frequent terms, ties by term)."""
    t = term_counts(df, text, key)
    if vocab_size:
        vocab = (t.groupBy("token").agg(F.sum("tf").alias("_n")).orderBy(F.desc("_n"), "token").limit(vocab_size)
                 .select("token"))
        t = t.join(F.broadcast(vocab), "token")  # at most vocab_size rows: bounded by the parameter
    return t.select(key, F.col("token").alias("term"), F.col("tf").alias("count"))


def vector_sparsity(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents, vocabulary size, non-zero cells and sparsity = 1 - nnz / (docs x vocab)."""
    cv = count_vectors(df, text, key)
    n_docs = df.count()
    return cv.agg(F.lit(n_docs).cast("long").alias("n_documents"), F.count_distinct("term").alias("vocabulary_size"),
                  F.count(F.lit(1)).alias("non_zero")).select(
        "n_documents", "vocabulary_size", "non_zero",
        rnd(1 - F.col("non_zero") / (F.col("n_documents") * F.col("vocabulary_size")), 6).alias("sparsity"))


def hashing_vectors(df: DataFrame, text: str = "text", key: str = "doc_id", num_features: int = 1 << 12) -> DataFrame:
    """MLlib HashingTF over the cleaned tokens."""
    from pyspark.ml.feature import HashingTF
    toks = df.select(key, clean_tokens(F.col(text)).alias("tokens"))
    return HashingTF(inputCol="tokens", outputCol="features", numFeatures=num_features).transform(toks)


# ---------------------------------------------------------------- N12 / N13
def entities(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, label, match) for every regex entity match."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.array(*[F.struct(F.lit(lbl).alias("label"), F.regexp_extract_all(t, F.lit(p), 0).alias("m"))
                      for lbl, p in ENTITY_PATTERNS.items()])
    return (df.select(key, F.explode(parts).alias("p")).select(key, "p.label", F.explode("p.m").alias("entity")))


def _located(text, label: str, pattern: str):
    """Array of (label, entity, start, end) of the matches in order: what stands between them gives the places."""
    gaps = F.split(text, pattern, -1)
    matches = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m, i: F.struct(m.alias("entity"), F.char_length(F.get(gaps, i)).alias("gap")))
    none = F.array().cast("array<struct<label:string,entity:string,start:int,end:int>>")

    def step(state, m):
        start = state["at"] + m["gap"]
        end = start + F.char_length(m["entity"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(F.lit(label).alias("label"), m["entity"].alias("entity"), start.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(matches, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda state: state["out"])


def entity_offsets(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """N12 offsets: character start / end of each match, folded from the lengths of matches and of the text between them."""
    every = F.concat(*[_located(F.coalesce(F.col(text), F.lit("")), lbl, p) for lbl, p in ENTITY_PATTERNS.items()])
    return df.select(key, F.explode(every).alias("e")).select(key, "e.*")


def entity_counts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Entity counts per type."""
    return entities(df, text, key).groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def top_entities(df: DataFrame, text: str = "text", key: str = "doc_id", top_k: int = 50) -> DataFrame:
    """The most frequent (label, entity) pairs."""
    return (entities(df, text, key).groupBy("label", "entity").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "label", "entity").limit(top_k))


# ---------------------------------------------------------------- N14
NEGATION_SCALAR = -0.74   # fixed value: valence multiplier after a negator
COMPOUND_ALPHA = 15.0     # fixed value: compound = s / sqrt(s^2 + alpha)


def sentiment(df: DataFrame, lexicon: DataFrame, negators: list[str], text: str = "text",
              key: str = "doc_id") -> DataFrame:
    """Lexicon valence summed over tokens (flipped after a negator), compound score and label.

    ``lexicon`` is a (term, valence) table; Spark broadcasts it when its size allows.
    """
    toks = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD + "+"), 0)
    # each token with the one before it, read from the array: no join back on the position
    pairs = F.get(F.transform(F.array(toks), lambda a: F.transform(a, lambda t, i: F.struct(t.alias("term"), F.get(a, i - 1).alias("prev")))), F.lit(0))
    pos = df.select(key, F.explode(pairs).alias("t")).select(key, "t.term", "t.prev")
    scored = pos.join(lexicon, "term")
    val = F.when(F.col("prev").isin(negators), F.col("valence") * NEGATION_SCALAR).otherwise(F.col("valence"))
    s = scored.groupBy(key).agg(F.sum(val).alias("s"), F.sum(F.when(val > 0, val).otherwise(0.0)).alias("pos_sum"),
                                F.sum(F.when(val < 0, -val).otherwise(0.0)).alias("neg_sum"))
    out = df.select(key).join(s, key, "left").fillna(0.0, ["s", "pos_sum", "neg_sum"])
    comp = F.col("s") / F.sqrt(F.col("s") * F.col("s") + COMPOUND_ALPHA)
    label = F.when(comp >= 0.05, "positive").when(comp <= -0.05, "negative").otherwise("neutral")
    return out.select(key, rnd(comp, 4).alias("compound"), rnd("pos_sum", 4).alias("positive"),
                      rnd("neg_sum", 4).alias("negative"), label.alias("label"))


def sentiment_summary(scores: DataFrame) -> DataFrame:
    """N14 aggregate: mean / std (ddof 0) / min / max of compound and the label distribution."""
    return scores.agg(rnd(F.avg("compound"), 4).alias("mean"), rnd(F.stddev_pop("compound"), 4).alias("std"),
                      rnd(F.min("compound"), 4).alias("min"), rnd(F.max("compound"), 4).alias("max"),
                      F.count_if(F.col("label") == "positive").alias("n_positive"),
                      F.count_if(F.col("label") == "negative").alias("n_negative"),
                      F.count_if(F.col("label") == "neutral").alias("n_neutral"))
