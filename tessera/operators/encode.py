"""Scaling, categorical encodings, numeric-text cleaning, dtype conversion, power transform.

Fit/apply split: every fitted operator has a ``fit`` step that returns bounded
statistics (a few numbers per column, or a dimension table of distinct values)
and an ``apply`` step that is a single projection or one dimension join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.quantiles import exact_quantiles
from ..functions.ranking import global_row_number
from ..functions.stats import as_double, numeric_columns


# ---------------------------------------------------------------- scaling
def scale_fit(df: DataFrame, columns: list[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """{column: (center, scale)} with nulls read as 0 (the reference fills 0 before fitting)."""
    cols = [c for c in columns if c in numeric_columns(df)]
    x = {c: F.coalesce(as_double(c), F.lit(0.0)) for c in cols}
    if method == "standard":
        row = df.agg(*[F.avg(x[c]).alias(f"a{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(x[c]).alias(f"b{i}") for i, c in enumerate(cols)]).first()
        fit = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols)}
    elif method == "minmax":
        row = df.agg(*[F.min(x[c]).alias(f"a{i}") for i, c in enumerate(cols)],
                     *[F.max(x[c]).alias(f"b{i}") for i, c in enumerate(cols)]).first()
        fit = {c: (row[f"a{i}"], (row[f"b{i}"] - row[f"a{i}"]) if row[f"a{i}"] is not None else None)
               for i, c in enumerate(cols)}
    elif method == "robust":
        quarters = exact_quantiles(df, {c: x[c] for c in cols}, [0.25, 0.5, 0.75])
        fit = {c: (q[1], q[2] - q[0]) if q else (None, None) for c, q in quarters.items()}
    else:
        raise ValueError(f"unknown scaling method {method!r}")
    # a zero scale is replaced by 1 (constant columns map to 0)
    return {c: (m, s if s not in (None, 0.0) else 1.0) for c, (m, s) in fit.items()}


def scale_apply(df: DataFrame, fit: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[
        ((F.coalesce(as_double(c), F.lit(0.0)) - F.lit(fit[c][0])) / F.lit(fit[c][1])).alias(c)
        if c in fit and fit[c][0] is not None else F.col(c) for c in df.columns])


def scale(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """Standard (ddof 0) / min-max / robust (median, IQR)."""
    return scale_apply(df, scale_fit(df, columns, method))


# ---------------------------------------------------------------- one-hot
def one_hot(df: DataFrame, columns: list[str], drop_first: bool = False,
            max_cardinality: int = CONFIG.one_hot_default_cap, on_wide: str = "raise") -> DataFrame:
    """T4: ``{col}_{value}`` boolean columns for columns with <= cap distinct values.

    The distinct values are fetched with a bound (cap + 1 rows per column), so a
    high-cardinality column is detected without collecting it; such a column is
    an error (``on_wide="raise"``) or is left as it is (``"skip"``). NULL gives all-false.
    """
    cap = min(max_cardinality, CONFIG.one_hot_hard_cap)
    out = df
    for c in columns:
        vals = [r[0] for r in df.select(F.col(c)).where(F.col(c).isNotNull()).distinct().limit(cap + 1).collect()]
        if len(vals) > cap:
            if on_wide == "skip":
                continue
            raise ValueError(f"{c} has more than {cap} values: encode it otherwise, or pass on_wide='skip'")
        vals = sorted(vals, key=lambda v: (str(type(v)), v))
        if drop_first:
            vals = vals[1:]
        new = [F.coalesce(F.col(c) == F.lit(v), F.lit(False)).alias(f"{c}_{_label(v)}") for v in vals]
        pos = out.columns.index(c)
        out = out.select(*[F.col(x) for x in out.columns[:pos]], *[F.col(x) for x in out.columns[pos + 1:]], *new)
    return out


def _label(v) -> str:
    return str(v)


# ---------------------------------------------------------------- codes
def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Dimension (value, code): code = rank of the value among sorted distinct strings, from 0."""
    vals = df.select(F.col(column).cast("string").alias("_v")).where(F.col("_v").isNotNull()).distinct()
    return global_row_number(vals, [F.col("_v")], "_code").select("_v", (F.col("_code") - 1).alias("_code"))


#: Codes up to this many are sent to the tasks; of more, only those of values that many rows hold.
FEW_CODES = 10_000


def label_encode(df: DataFrame, columns: list[str], few: int = FEW_CODES) -> DataFrame:
    """T5: replace each column by its code; NULL stays NULL. Rows of frequent values and NULLs are not moved to one task."""
    out = df
    for c in columns:
        dim = label_codes(df, c)
        out = out.withColumn("_v", F.col(c).cast("string"))
        if dim.count() <= few:
            out = out.join(F.broadcast(dim), "_v", "left")
        else:
            counts = df.select(F.col(c).cast("string").alias("_v")).groupBy("_v").count().orderBy(F.desc("count"), "_v").limit(few)
            hot = dim.join(F.broadcast(counts), "_v").select("_v", F.col("_code").alias("_hot"))  # at most ``few`` rows
            out = out.join(F.broadcast(hot), "_v", "left")
            # what needs no code of the large table is spread by its other columns and meets nothing there
            spread = F.when(F.col("_v").isNull() | F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))).otherwise(0)
            out = out.withColumn("_s", spread).join(dim.withColumn("_s", F.lit(0).cast("long")), ["_v", "_s"], "left")
            out = out.withColumn("_code", F.coalesce("_hot", "_code"))
        out = out.select(*[F.col("_code").cast("long").alias(c) if x == c else F.col(x) for x in df.columns])
    return out


def ordinal_encode(df: DataFrame, columns: list[str], order: dict[str, list[str]] | None = None) -> DataFrame:
    """Codes from a given order (literal map) or the sorted distinct values; unknown -> NULL."""
    order = order or {}
    out = df
    for c in columns:
        if c in order:
            m = F.create_map(*sum([[F.lit(str(v)), F.lit(i)] for i, v in enumerate(order[c])], []))
            out = out.withColumn(c, m[F.col(c).cast("string")].cast("long"))
        else:
            out = label_encode(out, [c])
    return out


def target_encode(df: DataFrame, columns: list[str], target: str, leave_one_out: bool = False) -> DataFrame:
    """``{col}_target_enc`` = mean target per category (optionally leave-one-out)."""
    out = df
    for c in columns:
        stats = df.groupBy(c).agg(F.avg(as_double(target)).alias("_m"), F.sum(as_double(target)).alias("_s"),
                                  F.count(as_double(target)).alias("_n"))
        stats = stats.where(F.col(c).isNotNull())
        out = out.join(stats, c, "left")
        enc = (F.try_divide(F.col("_s") - as_double(target), (F.col("_n") - 1).cast("double"))
               if leave_one_out else F.col("_m"))
        out = out.withColumn(f"{c}_target_enc", enc).drop("_m", "_s", "_n")
    return out


def frequency_encode(df: DataFrame, columns: list[str]) -> DataFrame:
    """``{col}_freq`` = share of rows holding the value (NULL for NULL)."""
    total = df.count()
    out = df
    for c in columns:
        counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("_f")).where(F.col(c).isNotNull())
        out = out.join(counts, c, "left").withColumn(f"{c}_freq", F.col("_f") / F.lit(float(total))).drop("_f")
    return out


# ---------------------------------------------------------------- numeric text and dtypes
# fixed values: currency symbols stripped from numeric text
CURRENCY = "$€£¥₹₽¢₩₪₦₨฿₴₸₵₡₢₣₤₧₮₰₲₳₶₷₺₻₼₾₿"


def clean_numeric_text(c) -> Column:
    """Drop currency symbols, commas, % and spaces; '(x)' means -x; then parse as double."""
    s = F.trim(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    s = F.regexp_replace(s, "[" + CURRENCY + ",% ]", "")
    s = F.regexp_replace(s, r"^\((.*)\)$", "-$1")
    return s.try_cast("double")


def clean_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[clean_numeric_text(c).alias(c) if c in columns else F.col(c) for c in df.columns])


_TRUE = ["true", "yes", "y", "1", "t"]
_FALSE = ["false", "no", "n", "0", "f"]


def convert_expr(c: str, target: str) -> Column:
    x = F.col(c)
    if target in ("float", "double"):
        return clean_numeric_text(c)
    if target in ("int", "integer", "long"):
        v = clean_numeric_text(c)
        return F.when(v == F.floor(v), v.try_cast("long"))
    if target in ("str", "string", "category"):
        return x.cast("string")
    if target == "datetime":
        return F.try_to_timestamp(x.cast("string"))
    if target == "bool":
        s = F.lower(F.trim(x.cast("string")))
        return F.when(s.isin(_TRUE), True).when(s.isin(_FALSE), False)
    raise ValueError(f"unknown dtype {target!r}")


def convert_dtype(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Convert columns; values that do not convert become NULL."""
    return df.select(*[convert_expr(c, target).alias(c) if c in columns else F.col(c) for c in df.columns])


def convert_loss(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Per column, non-null values before and after conversion, and how many were lost."""
    from .profile import long_agg
    out = long_agg(df, {c: {"before": F.count(F.col(c)), "after": F.count(convert_expr(c, target))} for c in columns})
    return out.select("column_name", "before", "after", (F.col("before") - F.col("after")).alias("lost"))


# ---------------------------------------------------------------- Yeo-Johnson
def yeo_johnson_expr(x: Column, lam: float) -> Column:
    pos = (F.pow(x + 1.0, lam) - 1.0) / lam if abs(lam) > 1e-12 else F.log1p(x)
    neg = -(F.pow(1.0 - x, 2.0 - lam) - 1.0) / (2.0 - lam) if abs(lam - 2.0) > 1e-12 else -F.log1p(-x)
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson_fit(df: DataFrame, columns: list[str], lo: float = -2.0, hi: float = 2.0,
                    grid: int = 41, rounds: int = 4) -> dict[str, float]:
    """Maximum-likelihood lambda per column by successive grid refinement.

    Each round is ONE aggregate evaluating ``grid`` lambdas for every column:
    llf = -n/2 * log(var_pop(yj(x))) + (lambda - 1) * sum(sign(x) * log1p(|x|)).
    A best value at the edge of the range moves the range on, in that and more rounds, so lo and hi are only where it starts.
    """
    cols = [c for c in columns if c in numeric_columns(df)]
    x = {c: F.coalesce(as_double(c), F.lit(0.0)) for c in cols}
    bounds = {c: (lo, hi) for c in cols}
    best, best_of = {}, {c: -math.inf for c in cols}
    base = df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.sum(F.signum(x[c]) * F.log1p(F.abs(x[c]))).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    n = base["n"]
    left = {c: rounds for c in cols}
    while any(left.values()):
        lams = {c: [bounds[c][0] + (bounds[c][1] - bounds[c][0]) * k / (grid - 1) for k in range(grid)] for c in cols}
        exprs = [F.var_pop(yeo_johnson_expr(x[c], lam)).alias(f"v{i}_{k}")
                 for i, c in enumerate(cols) for k, lam in enumerate(lams[c])]
        row = df.agg(*exprs).first()
        for i, c in enumerate(cols):
            if not left[c]:
                continue
            scores = []
            for k, lam in enumerate(lams[c]):
                v = row[f"v{i}_{k}"]
                llf = -math.inf if not v or v <= 0 else -n / 2.0 * math.log(v) + (lam - 1.0) * base[f"s{i}"]
                scores.append((llf, -abs(lam), lam))
            _, _, lam_best = max(scores)
            best[c] = lam_best
            low, high = bounds[c]
            step = (high - low) / (grid - 1)
            at_edge = lam_best in (lams[c][0], lams[c][-1]) and best_of[c] < max(scores)[0] < math.inf
            best_of[c] = max(best_of[c], max(scores)[0])
            if at_edge:
                bounds[c] = (lam_best - (high - low) / 2, lam_best + (high - low) / 2)
            else:
                bounds[c], left[c] = (lam_best - step, lam_best + step), max(left[c] - 1, 0)
    return best


def yeo_johnson(df: DataFrame, columns: list[str], lambdas: dict[str, float] | None = None,
                standardize: bool = True) -> DataFrame:
    """Yeo-Johnson with given or fitted lambdas, then standardised (ddof 0); nulls read as 0."""
    lambdas = lambdas or yeo_johnson_fit(df, columns)
    t = df.select(*[yeo_johnson_expr(F.coalesce(as_double(c), F.lit(0.0)), lambdas[c]).alias(c)
                    if c in lambdas else F.col(c) for c in df.columns])
    return scale(t, list(lambdas), "standard") if standardize else t


TRANSFORM_ACTIONS = {
    "scale": scale, "one_hot": one_hot, "label_encode": label_encode, "ordinal_encode": ordinal_encode,
    "target_encode": target_encode, "frequency_encode": frequency_encode, "clean_numeric": clean_numeric,
    "convert_dtype": convert_dtype, "yeo_johnson": yeo_johnson,
}
