"""Aggregates behind charts (histogram, box plot, scatter, correlation matrix, residuals).

Only the numbers a chart needs are produced; drawing is out of scope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.quantiles import exact_quantiles
from ..functions.stats import as_double, numeric_columns, rnd, safe_corr


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None,
              max_groups: int | None = None) -> DataFrame:
    """V1 / V5: equal-width bins over [min, max]; every bin is [lo, hi) except the last, [lo, hi].

    Edges are computed once on the whole column (shared by all groups). Empty bins
    are not listed.
    """
    x = as_double(column)
    lo, hi, = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, count long")
    width = (hi - lo) / bins if hi > lo else 1.0
    idx = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = [idx.alias("bin")]
    src = df.where(x.isNotNull())
    if by is not None:
        if max_groups:
            top = [r[0] for r in src.groupBy(by).count().orderBy(F.desc("count"), by).limit(max_groups).collect()]
            src = src.where(F.col(by).isin(top))
        keys = [F.col(by)] + keys
    out = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    return out.select(*([by] if by else []), "bin",
                      rnd(F.lit(lo) + F.col("bin") * F.lit(width), 4).alias("bin_start"),
                      rnd(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 4).alias("bin_end"), "count")


def histogram_stats(df: DataFrame, column: str) -> DataFrame:
    """V1 stats: count, mean, std (ddof 1), min, max, median."""
    x = as_double(column)
    middle = exact_quantiles(df, {column: x}, [0.5])[column] or [None]
    return df.agg(F.count(x).alias("count"), rnd(F.avg(x), 4).alias("mean"), rnd(F.stddev_samp(x), 4).alias("std"),
                  rnd(F.min(x), 4).alias("min"), rnd(F.max(x), 4).alias("max"),
                  rnd(F.max(F.lit(middle[0]).cast("double")), 4).alias("median"))


def box_plot(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """V2: quartiles, whiskers (most extreme values inside the 1.5 IQR fences), mean, std, outliers."""
    from .profile import long_agg
    cols = columns or numeric_columns(df)
    quarters = exact_quantiles(df, {c: as_double(c) for c in cols}, [0.25, 0.5, 0.75])
    spec = {}
    for c in cols:
        x = as_double(c)
        q1, q2, q3 = quarters[c] or [None] * 3
        lo, hi = (None, None) if q1 is None else (q1 - CONFIG.iqr_multiplier * (q3 - q1), q3 + CONFIG.iqr_multiplier * (q3 - q1))
        spec[c] = {"q": F.max(F.array(*[F.lit(v).cast("double") for v in (q1, q2, q3)])),
                   "whisker_low": F.min(F.when(x >= F.lit(lo), x)), "whisker_high": F.max(F.when(x <= F.lit(hi), x)),
                   "mean": F.avg(x), "std": F.stddev_samp(x),
                   "n_outliers": F.count_if((x < F.lit(lo)) | (x > F.lit(hi)))}
    out = long_agg(df, spec)
    return out.select("column_name", rnd(F.col("q")[0], 4).alias("q1"), rnd(F.col("q")[1], 4).alias("median"),
                      rnd(F.col("q")[2], 4).alias("q3"), rnd("whisker_low", 4).alias("whisker_low"),
                      rnd("whisker_high", 4).alias("whisker_high"), rnd("mean", 4).alias("mean"),
                      rnd("std", 4).alias("std"), "n_outliers")


def scatter_corr(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """V3: correlation and count overall and per hue value."""
    overall = df.agg(F.lit("__all__").alias("hue"), F.count(F.lit(1)).alias("n"), rnd(safe_corr(x, y), 4).alias("correlation"))
    if hue is None:
        return overall
    per = (df.where(F.col(hue).isNotNull()).groupBy(F.col(hue).cast("string").alias("hue"))
           .agg(F.count(F.lit(1)).alias("n"), rnd(safe_corr(x, y), 4).alias("correlation")))
    return overall.unionByName(per)


def corr_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """V4: full correlation matrix of the numeric columns in long form, diagonal included."""
    cols = columns or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = df.agg(*[safe_corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    rows = []
    for k, (a, b) in enumerate(pairs):
        rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), rnd(F.col(f"r{k}"), 4).alias("correlation")))
        rows.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), rnd(F.col(f"r{k}"), 4).alias("correlation")))
    for c in cols:
        rows.append(F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.lit(1.0).alias("correlation")))
    return one.select(F.inline(F.array(*rows)))


def residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """V7: residual mean / std (ddof 0) / min / max."""
    e = as_double(label) - as_double(prediction)
    return df.agg(rnd(F.avg(e), 4).alias("mean"), rnd(F.stddev_pop(e), 4).alias("std"),
                  rnd(F.min(e), 4).alias("min"), rnd(F.max(e), 4).alias("max"), F.count(e).alias("n"))
