"""Text queries over documents / conversations / pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as X
from .registry import query
from .tables import table

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
W = r"[\p{L}\p{N}_]"


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def _clean_sql(t: str) -> str:
    s = f"lower(coalesce({t}, ''))"
    s = f"regexp_replace({s}, 'http\\S+|www\\.\\S+', '', 'g')"
    s = f"regexp_replace({s}, '<[^>]+>', '', 'g')"
    s = f"regexp_replace({s}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')"
    toks = f"regexp_extract_all({s}, '\\S+')"
    return f"list_filter({toks}, lambda x: NOT list_contains({STOP_SQL}, x) AND length(x) >= 2)"


@query("detect_text", sql=r"""
SELECT * FROM (
  SELECT 'text' AS column_name, round(avg(len(regexp_extract_all(text, '\S+'))), 2) AS avg_words, round(avg(length(text)), 2) AS avg_chars FROM conversations
  UNION ALL SELECT 'role', round(avg(len(regexp_extract_all(role, '\S+'))), 2), round(avg(length(role)), 2) FROM conversations)
WHERE avg_words >= 3 OR avg_chars >= 20""")
def detect_text(spark, sf):
    return X.detect_text(table(spark, sf, "conversations").select("role", "text"))


@query("text_clean", sql=f"""
SELECT doc_id, array_to_string(toks, ' ') AS clean_text, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS n_tokens_before,
       len(toks) AS n_tokens_after FROM (SELECT doc_id, text, {_clean_sql('text')} AS toks FROM documents)""")
def text_clean(spark, sf):
    return X.text_clean(_docs(spark, sf))


@query("tokenize", sql=f"""
SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_clean_sql('text')}) AS token FROM documents) GROUP BY 1, 2""")
def tokenize(spark, sf):
    return X.term_counts(_docs(spark, sf))


@query("text_stats", sql=r"""
WITH x AS (SELECT len(regexp_extract_all(coalesce(text, ''), '\S+')) AS w, length(coalesce(text, '')) AS c,
                  len(regexp_extract_all(coalesce(text, ''), '[.!?]+')) AS s, coalesce(text, '') = '' AS empty FROM documents)
SELECT count(*) AS total_documents, count(*) FILTER (WHERE empty) AS empty_documents, round(avg(w), 2) AS words_mean,
       round(quantile_cont(w, 0.5), 2) AS words_median, min(w) AS words_min, max(w) AS words_max, round(stddev_samp(w), 2) AS words_std,
       round(avg(c), 1) AS chars_mean, round(quantile_cont(c, 0.5), 1) AS chars_median, min(c) AS chars_min, max(c) AS chars_max,
       round(avg(s), 2) AS sentences_mean, round(quantile_cont(s, 0.5), 2) AS sentences_median FROM x""")
def text_stats(spark, sf):
    return X.text_stats(_docs(spark, sf))


_WORDS = f"""wc AS (SELECT word, count(*) AS count FROM (
  SELECT unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '{W}+'),
                            lambda x: regexp_full_match(x, '[a-zA-Z]{{2,}}') AND NOT list_contains({STOP_SQL}, x))) AS word
  FROM documents) GROUP BY word)"""


@query("word_cloud", sql=f"""WITH {_WORDS},
top AS (SELECT * FROM wc ORDER BY count DESC, word LIMIT 100)
SELECT word, count, round(CAST(count AS DOUBLE) / (SELECT max(count) FROM top), 4) AS weight FROM top""")
def word_cloud(spark, sf):
    return X.word_cloud(_docs(spark, sf), top_k=100)


@query("keywords_freq", sql=f"""WITH {_WORDS}
SELECT word AS keyword, round(CAST(count AS DOUBLE) / (SELECT sum(count) FROM wc), 6) AS score, count FROM wc
ORDER BY count DESC, word LIMIT 20""")
def keywords_freq(spark, sf):
    return X.keywords_freq(_docs(spark, sf), top_k=20)


def _tfidf_sql(ngram_max: int) -> str:
    toks = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '{W}{{2,}}'), lambda x: NOT list_contains({STOP_SQL}, x))"
    bigrams = ("UNION ALL SELECT doc_id, unnest(list_transform(range(0, len(toks) - 1), "
               "lambda i: toks[i + 1] || ' ' || toks[i + 2])) FROM t WHERE len(toks) >= 2") if ngram_max >= 2 else ""
    return f"""t AS (SELECT doc_id, {toks} AS toks FROM documents),
g AS (SELECT doc_id, unnest(toks) AS term FROM t {bigrams}),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT doc_id, term, tf, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w
      FROM tf JOIN dfq USING (term)),
nr AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY 1),
tw AS (SELECT doc_id, term, tf, w / nrm AS weight FROM w JOIN nr USING (doc_id))"""


@query("keywords_tfidf", sql=f"""WITH {_tfidf_sql(2)}
SELECT term AS keyword, round(sum(weight) / (SELECT count(*) FROM documents), 6) AS score FROM tw
GROUP BY term ORDER BY sum(weight) / (SELECT count(*) FROM documents) DESC, term LIMIT 20""")
def keywords_tfidf(spark, sf):
    return X.keywords_tfidf(_docs(spark, sf), top_k=20, ngram_max=2)


@query("tfidf_vectors", sql=f"""WITH {_tfidf_sql(1)}
SELECT doc_id, term, tf, round(weight, 4) AS weight FROM tw""")
def tfidf_vectors(spark, sf):
    t = X.tfidf_terms(_docs(spark, sf), ngram_max=1)
    return t.select("doc_id", "term", "tf", (F.round(F.col("weight") * 1e4, 0) / 1e4).alias("weight"))


_CV = f"""tc AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_clean_sql('text')}) AS token FROM documents) GROUP BY 1, 2)"""


@query("count_vectors", sql=f"""WITH {_CV}
SELECT doc_id, token AS term, tf AS count FROM tc""")
def count_vectors(spark, sf):
    return X.count_vectors(_docs(spark, sf))


@query("vector_sparsity", sql=f"""WITH {_CV}
SELECT (SELECT count(*) FROM documents) AS n_documents, count(DISTINCT token) AS vocabulary_size, count(*) AS non_zero,
       round(1 - count(*) / ((SELECT count(*) FROM documents) * count(DISTINCT token)), 6) AS sparsity FROM tc""")
def vector_sparsity(spark, sf):
    return X.vector_sparsity(_docs(spark, sf))


@query("hashing_vectors")
def hashing_vectors(spark, sf):
    from pyspark.ml.functions import vector_to_array
    h = X.hashing_vectors(_docs(spark, sf))
    cells = F.filter(F.transform(vector_to_array("features"), lambda v, i: F.struct(i.alias("bucket"), v.alias("count"))), lambda x: x["count"] != 0)
    return h.select("doc_id", F.explode(cells).alias("c")).select("doc_id", "c.bucket", "c.count")


def _ent_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT doc_id, '{lbl}' AS label, unnest(regexp_extract_all(coalesce(text, ''), '{p}')) AS entity FROM documents"
        for lbl, p in X.ENTITY_PATTERNS.items())


@query("entities", sql=_ent_sql())
def entities(spark, sf):
    return X.entities(_docs(spark, sf))


@query("entity_counts", sql=f"SELECT label, count(*) AS count FROM ({_ent_sql()}) GROUP BY label")
def entity_counts(spark, sf):
    return X.entity_counts(_docs(spark, sf))


@query("entity_offsets")
def entity_offsets(spark, sf):
    return X.entity_offsets(_docs(spark, sf))


@query("top_entities", sql=f"""
SELECT label, entity, count(*) AS count FROM ({_ent_sql()}) GROUP BY 1, 2 ORDER BY count DESC, label, entity LIMIT 50""")
def top_entities(spark, sf):
    return X.top_entities(_docs(spark, sf))


# fixed values: the example lexicon (term, valence) and negators
LEXICON = [("good", 1.9), ("great", 3.1), ("bad", -2.5), ("poor", -2.1), ("the", 0.4), ("and", 0.2), ("is", -0.3),
           ("with", 0.6)]
NEGATORS = ["not", "no"]
_LEX_SQL = "(VALUES " + ", ".join(f"('{t}', CAST({v} AS DOUBLE))" for t, v in LEXICON) + ") lx(term, valence)"


def _lexicon(spark):
    return spark.createDataFrame(LEXICON, "term string, valence double")


_SENT_SQL = f"""
p AS (SELECT doc_id, unnest(toks) AS term, unnest(range(0, len(toks))) AS i FROM (
        SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{W}+') AS toks FROM documents)),
v AS (SELECT a.doc_id, CASE WHEN b.term IN ('not', 'no') THEN lx.valence * CAST(-0.74 AS DOUBLE) ELSE lx.valence END AS val
      FROM p a JOIN {_LEX_SQL} ON a.term = lx.term LEFT JOIN p b ON a.doc_id = b.doc_id AND b.i + 1 = a.i),
s AS (SELECT doc_id, sum(val) AS s, sum(CASE WHEN val > 0 THEN val ELSE 0.0 END) AS ps,
             sum(CASE WHEN val < 0 THEN -val ELSE 0.0 END) AS ns FROM v GROUP BY 1),
sc AS (SELECT d.doc_id, coalesce(s.s, 0.0) / sqrt(coalesce(s.s, 0.0) * coalesce(s.s, 0.0) + 15.0) AS compound,
              coalesce(ps, 0.0) AS ps, coalesce(ns, 0.0) AS ns FROM documents d LEFT JOIN s USING (doc_id)),
lab AS (SELECT doc_id, round(compound, 4) AS compound, round(ps, 4) AS positive, round(ns, 4) AS negative,
               CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM sc)"""


@query("sentiment", sql=f"WITH {_SENT_SQL}\nSELECT * FROM lab")
def sentiment(spark, sf):
    return X.sentiment(_docs(spark, sf), _lexicon(spark), NEGATORS)


@query("sentiment_summary", sql=f"""WITH {_SENT_SQL}
SELECT round(avg(compound), 4) AS mean, round(stddev_pop(compound), 4) AS std, round(min(compound), 4) AS min,
       round(max(compound), 4) AS max, count(*) FILTER (WHERE label = 'positive') AS n_positive,
       count(*) FILTER (WHERE label = 'negative') AS n_negative, count(*) FILTER (WHERE label = 'neutral') AS n_neutral FROM lab""")
def sentiment_summary(spark, sf):
    return X.sentiment_summary(X.sentiment(_docs(spark, sf), _lexicon(spark), NEGATORS))
