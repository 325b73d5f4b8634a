"""Anomaly detection: z-score, modified z-score (MAD), IQR fences, consensus vote.

Results are keyed by the caller's row key: every method returns the input rows
plus ``is_anomaly`` (and a score), so methods combine by key, never by position.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.quantiles import exact_quantiles
from ..functions.stats import as_double, numeric_columns, rnd
from .quality import iqr_fences


def zscore_fit(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    """{column: (mean, std ddof 1 or None when 0)}."""
    row = df.agg(*[F.avg(as_double(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(as_double(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] if row[f"s{i}"] else None) for i, c in enumerate(cols)}


def _z(c: str, m, s):
    return F.lit(None).cast("double") if s is None or m is None else F.abs((as_double(c) - F.lit(m)) / F.lit(s))


def zscore_flags(df: DataFrame, columns: list[str] | None = None,
                 threshold: float = CONFIG.zscore_threshold) -> DataFrame:
    """A1: |z| > threshold in any column (a zero std never flags)."""
    cols = columns or numeric_columns(df)
    fit = zscore_fit(df, cols)
    zs = [_z(c, *fit[c]) for c in cols]
    hit = reduce(lambda a, b: a | b, [F.coalesce(z > threshold, F.lit(False)) for z in zs])
    return df.select("*", F.greatest(*zs).alias("max_abs_z") if len(zs) > 1 else zs[0].alias("max_abs_z"),
                     hit.alias("is_anomaly"))


def zscore_stats(df: DataFrame, columns: list[str] | None = None,
                 threshold: float = CONFIG.zscore_threshold) -> DataFrame:
    """A1 per-column stats: outlier count, max and mean |z|."""
    from .profile import long_agg
    cols = columns or numeric_columns(df)
    fit = zscore_fit(df, cols)
    spec = {c: {"outlier_count": F.count_if(_z(c, *fit[c]) > threshold),
                "max_zscore": rnd(F.max(_z(c, *fit[c])), 4), "mean_zscore": rnd(F.avg(_z(c, *fit[c])), 4)}
            for c in cols}
    return long_agg(df, spec)


def mad_flags(df: DataFrame, columns: list[str] | None = None,
              threshold: float = CONFIG.modified_z_threshold) -> DataFrame:
    """A2: modified z = 0.6745 (x - median) / MAD > threshold in any column (two exact medians)."""
    cols = columns or numeric_columns(df)
    med = {c: q and q[0] for c, q in exact_quantiles(df, {c: as_double(c) for c in cols}, [0.5]).items()}
    mads = {c: q and q[0] for c, q in exact_quantiles(
        df, {c: F.abs(as_double(c) - F.lit(med[c])) for c in cols}, [0.5]).items()}
    zs = []
    for i, c in enumerate(cols):
        m, d = med[c], mads[c]
        zs.append(F.lit(None).cast("double") if not d else
                  F.abs(F.lit(CONFIG.modified_z_constant) * (as_double(c) - F.lit(m)) / F.lit(d)))
    hit = reduce(lambda a, b: a | b, [F.coalesce(z > threshold, F.lit(False)) for z in zs])
    return df.select("*", (F.greatest(*zs) if len(zs) > 1 else zs[0]).alias("max_modified_z"), hit.alias("is_anomaly"))


def iqr_flags(df: DataFrame, columns: list[str] | None = None,
              multiplier: float = CONFIG.iqr_multiplier) -> DataFrame:
    """A3: outside the Tukey fences in any column."""
    cols = columns or numeric_columns(df)
    fences = iqr_fences(df, cols, multiplier)
    hit = reduce(lambda a, b: a | b, [F.coalesce((as_double(c) < F.lit(lo)) | (as_double(c) > F.lit(hi)), F.lit(False))
                                      for c, (lo, hi) in fences.items() if lo is not None])
    return df.select("*", hit.alias("is_anomaly"))


def iqr_bounds(df: DataFrame, columns: list[str] | None = None,
               multiplier: float = CONFIG.iqr_multiplier) -> DataFrame:
    """A3 per-column bounds and outlier counts."""
    from .profile import long_agg
    cols = columns or numeric_columns(df)
    fences = iqr_fences(df, cols, multiplier)
    spec = {c: {"lower_bound": rnd(F.lit(lo), 4), "upper_bound": rnd(F.lit(hi), 4),
                "outlier_count": F.count_if((as_double(c) < F.lit(lo)) | (as_double(c) > F.lit(hi)))}
            for c, (lo, hi) in fences.items()}
    return long_agg(df, spec)


def consensus(flags: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Votes per row key across methods; anomaly when votes >= n_methods / 2 (ties count)."""
    n = len(flags)
    parts = [f.select(*key, F.col("is_anomaly").cast("int").alias("vote")) for f in flags.values()]
    votes = reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.sum("vote").alias("votes"))
    return votes.select(*key, "votes", (F.col("votes") * 2 >= F.lit(n)).alias("is_anomaly"))


def pca_reconstruction_flags(df: DataFrame, columns: list[str], key: str, contamination: float = 0.05,
                             k: int | None = None) -> DataFrame:
    """Squared reconstruction error through the first k = max(2, p // 3) principal components
    of the standardised columns (a linear autoencoder); the top ``contamination`` share is flagged."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    from .encode import scale
    from .ml import assemble
    z = scale(df.select(key, *columns), columns, "standard")
    k = k or max(2, len(columns) // 3)
    vec = assemble(columns, "_x").transform(z)
    model = PCA(k=k, inputCol="_x", outputCol="_p").fit(vec)
    pcs = model.pc.toArray()  # p x k loadings: bounded by the number of columns
    proj = model.transform(vec).select(key, vector_to_array("_x").alias("x"), vector_to_array("_p").alias("s"))
    recon = [reduce(lambda a, b: a + b, [F.col("s")[j] * float(pcs[i, j]) for j in range(k)]) for i in range(len(columns))]
    err = reduce(lambda a, b: a + b, [(F.col("x")[i] - recon[i]) ** 2 for i in range(len(columns))])
    scored = proj.select(key, err.alias("recon_error"))
    cut = scored.agg(F.percentile_approx("recon_error", 1 - contamination, 10000)).first()[0]
    return scored.select(key, rnd("recon_error", 4).alias("recon_error"), (F.col("recon_error") > F.lit(cut)).alias("is_anomaly"))
