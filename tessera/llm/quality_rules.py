"""Quality rules: fixed base rules, then robust multivariate outliers by language and source.

One pass over the texts makes a slim table of counts. Documents that pass the base rules
are described by transformed statistics (rates per word, shrunk for short texts, square
roots of shares, the logarithm of the length). For each language and source the minimum
covariance determinant is estimated with concentration steps: start at medians and
interquartile ranges, keep the ``h`` share of the rows that are nearest, take their mean and
covariance, and repeat ``steps`` times. A document stays if its Mahalanobis distance to
its group's estimate is below the chi-square quantile ``p``.

All steps are grouped aggregations over the slim table: order statistics come from
fixed-width histograms (exact counts, combined before the shuffle, the same in every
run), moments from ``covar_pop``. A group with a third of all rows is never gathered.
Sources with fewer than ``least`` rows of a language are pooled, first within the language,
then over all. ``FLOORS`` are added to the variances: where nearly all documents have a
statistic of exactly 0 the covariance would be singular.

Defined cases: a null text has no words and fails the base rules; null language and null
source are values of their own; a document with the base failed is never kept and
takes no part in the estimates; rows that repeat are rows of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textfn import let, words

SALTS = 32  # parts in which the rows of a group are joined with what is known of the group
WINDOW = 8  # words; a window found twice makes its words repeated
PRIOR = 50  # words by which rates of short texts are shrunk
#: Standard deviations added to each statistic, in the order of ``statistics()``.
FLOORS = (1.0, 0.35, 0.12, 0.12, 0.15, 0.12, 0.12)
BINS = 50  # histogram bins for a unit of a statistic, or of the logarithm of a distance


def repeated_words(ws: Column) -> Column:
    """Words inside windows that are found twice or more, each word once."""
    windows = F.transform(F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))

    def positions(s):  # of windows whose neighbour in hash order is equal
        def twin(x, j):
            same = lambda k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.when(same(j - 1) | same(j + 1), x["i"])
        return F.sort_array(F.filter(F.transform(s, twin), lambda p: p.isNotNull()))

    def covered(p):
        steps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(h):
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
                lambda s: let(positions(s), covered)))

    return F.when(F.size(ws) < WINDOW + 1, F.lit(0)).otherwise(let(windows, count))


def counts(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """The slim table: one row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    full_lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    lines = let(full_lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    of_words = let(words(text), lambda w: F.struct(
        F.size(w).alias("n"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("chars"),
        repeated_words(w).alias("rep")))
    long = lambda c: c.cast("long")
    return (df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
                      of_words.alias("w"), lines.alias("l"),
                      long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
                      long(F.regexp_count(text, F.lit(r"\p{Lu}"))).alias("n_upper"),
                      long(F.regexp_count(text, F.lit(r"[!?.,;:]"))).alias("n_marks"))
            .select("id", "lang", "source", long(F.col("w.n")).alias("n_words"), long(F.col("w.chars")).alias("word_chars"),
                    "n_symbols", long(F.col("l.dup")).alias("n_dup_lines"), long(F.col("w.rep")).alias("n_repeat_words"),
                    long(F.col("l.n")).alias("n_lines"), "n_upper", "n_marks")
            .withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)))


def statistics() -> list[Column]:
    """Transformed statistics, each with a spread of the order of 1 or below."""
    n = F.col("n_words")
    share = lambda a, b: F.sqrt(a / (b + F.lit(PRIOR)))
    return [F.log1p(n.cast("double")), (F.col("word_chars") + 5.0 * PRIOR) / (n + PRIOR),
            share(F.col("n_symbols"), n), share(F.col("n_repeat_words"), n),
            F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)),
            share(F.col("n_upper"), F.col("word_chars")) * 2, share(F.col("n_marks"), n)]


def _groups(rows: DataFrame, least: int) -> DataFrame:
    """Adds ``lang`` and ``source`` of the group that a row is judged with (pooled: '*')."""
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.where(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("pool"))
    sizes = sizes.join(small.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left").select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"),
        F.when(F.col("n") >= least, F.concat(F.lit("source "), F.to_json(F.struct("lang", "source"))))
        .when(F.col("pool") >= least, F.concat(F.lit("language "), F.to_json(F.struct("lang"))))
        .otherwise(F.lit("all")).alias("grp"))
    return rows.join(sizes, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_lang", "_source")


def _quantiles(hist: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """From rows (keys, bin, n): the first bin at which each share of the rows is reached."""
    w = Window.partitionBy(*keys)
    upto = hist.withColumn("_upto", F.sum("n").over(w.orderBy("bin"))).withColumn("_all", F.sum("n").over(w))
    return upto.groupBy(*keys).agg(*[
        F.min(F.when(F.col("_upto") >= F.col("_all") * q, F.col("bin"))).alias(name) for name, q in shares.items()])


def _start(rows: DataFrame, d: int) -> DataFrame:
    """Medians and interquartile ranges as mean and inverse factor."""
    long = rows.select("grp", F.posexplode("x").alias("k", "v")).groupBy(
        "grp", "k", F.round(F.col("v") * BINS).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    q = _quantiles(long, ["grp", "k"], {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    wide = q.groupBy("grp").agg(*[F.max(F.when(F.col("k") == i, F.col(c) / BINS)).alias(f"{c}_{i}")
                                  for i in range(d) for c in ("q1", "q2", "q3")])
    spread = lambda i: (F.col(f"q3_{i}") - F.col(f"q1_{i}")) / F.lit(1.349)
    inverse = F.array(*[F.when(F.lit(i == j), 1 / F.sqrt(spread(i) * spread(i) + FLOORS[i] ** 2)).otherwise(F.lit(0.0))
                        for i in range(d) for j in range(i + 1)])
    return wide.select("grp", F.array(*[F.col(f"q2_{i}") for i in range(d)]).alias("mean"), inverse.alias("inv"))


def _salted(per_group: DataFrame) -> DataFrame:
    return per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _distance(rows: DataFrame, fit: DataFrame, d: int) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance under the group's estimate.

    Estimates are repeated for each salt, so the rows of a hot group meet theirs in many tasks."""
    z = []
    for i in range(d):
        first = i * (i + 1) // 2
        terms = [F.get("inv", F.lit(first + j)) * (F.get("x", F.lit(j)) - F.get("mean", F.lit(j))) for j in range(i + 1)]
        z.append(sum(terms[1:], terms[0]))
    return rows.join(_salted(fit), ["grp", "salt"]).withColumn("z", F.array(*z)).withColumn(
        "d2", F.aggregate("z", F.lit(0.0), lambda a, b: a + b * b)).drop("mean", "inv", "z")


def _inverse_factor(moments: DataFrame, d: int, scale: float) -> DataFrame:
    """Rows (grp, mean, inv): the inverse of the Cholesky factor of scale * covariance + floors, row by row."""
    t = moments
    c = lambda i, j: F.col(f"c_{max(i, j)}_{min(i, j)}") * scale + (FLOORS[i] ** 2 if i == j else 0.0)
    for j in range(d):  # column by column; each uses the columns before it
        done = sum((F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        t = t.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(c(j, j) - done, F.lit(1e-9))))
        t = t.withColumns({f"l_{i}_{j}": (c(i, j) - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0)))
                           / F.col(f"l_{j}_{j}") for i in range(j + 1, d)})
    for i in range(d):  # forward substitution
        t = t.withColumns({f"v_{i}_{j}": (F.lit(float(i == j)) - sum((F.col(f"l_{i}_{k}") * F.col(f"v_{k}_{j}") for k in range(j, i)), F.lit(0.0)))
                           / F.col(f"l_{i}_{i}") for j in range(i + 1)})
    return t.select("grp", F.array(*[F.col(f"m_{i}") for i in range(d)]).alias("mean"),
                    F.array(*[F.col(f"v_{i}_{j}") for i in range(d) for j in range(i + 1)]).alias("inv"))


def chi_square_quantile(p: float, d: int) -> float:
    """Wilson-Hilferty approximation."""
    a = 2 / (9 * d)
    return d * (1 - a + NormalDist().inv_cdf(p) * math.sqrt(a)) ** 3


def chi_square_share(x: float, d: int) -> float:
    return NormalDist().cdf(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))


def estimate(rows: DataFrame, scratch: Scratch, d: int, h: float, steps: int) -> DataFrame:
    """MCD estimates (grp, mean, inv) of rows (grp, salt, x array of d doubles)."""
    scale = h / chi_square_share(chi_square_quantile(h, d), d + 2)  # the h nearest rows understate the spread
    fit = scratch.keep(_start(rows, d), "fit0")
    for step in range(1, steps + 1):
        near = _distance(rows, fit, d).withColumn("bin", F.round(F.log(F.col("d2") + 1e-6) * BINS).cast("long"))
        cut = _quantiles(near.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n")), ["grp"], {"cut": h})
        x = [F.get("x", F.lit(i)) for i in range(d)]
        moments = near.join(_salted(cut), ["grp", "salt"]).where("bin <= cut").groupBy("grp").agg(
            *[F.round(F.avg(x[i]), 9).alias(f"m_{i}") for i in range(d)],
            *[F.round(F.covar_pop(x[i], x[j]), 9).alias(f"c_{i}_{j}") for i in range(d) for j in range(i + 1)])
        fit = scratch.keep(_inverse_factor(moments, d, scale), f"fit{step}")
        scratch.drop(f"fit{step - 1}")
    return fit


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source", h: float = 0.75, steps: int = 4, least: int = 60,
                  p: float = 0.9999) -> DataFrame:
    """One row per input row: ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept``, and ``distance`` (squared Mahalanobis distance; null if the base failed)."""
    scratch = Scratch(df.sparkSession, "quality")
    slim = scratch.keep(counts(df, id_col, text_col, lang_col, source_col), "counts")
    x = statistics()
    salt = F.pmod(F.xxhash64(F.lit(9), "id", "word_chars"), F.lit(SALTS)).cast("int")
    good = scratch.keep(_groups(slim.where(~F.col("base_failed")).withColumn("x", F.array(*x)), least).withColumn("salt", salt), "statistics")
    fit = estimate(good.select("grp", "salt", "x"), scratch, len(x), h, steps)
    judged = _distance(good, fit, len(x)).withColumn("kept", F.col("d2") <= chi_square_quantile(p, len(x)))
    out = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    failed = slim.where("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("d2"))
    return (judged.select(*out, "kept", "d2").unionByName(failed)
            .withColumnsRenamed({"id": id_col, "d2": "distance"}))
