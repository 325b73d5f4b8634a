"""Data-quality checks, issue list and score (long-form DataFrames).

Fitted statistics (quartiles, fences) are computed by one aggregate and brought
to the driver as a single row of at most a few numbers per column; they are then
applied as literals, which keeps every later pass inside whole-stage codegen and
needs no join at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.quantiles import exact_quantiles
from ..functions.stats import rnd, as_double, numeric_columns, safe_corr, string_columns
from .profile import distinct_counts, long_agg

ISSUE_SCHEMA = "issue_type string, column_name string, severity string, count long, pct double"


# ---------------------------------------------------------------- fit helpers
def quartiles(df: DataFrame, cols: list[str], approx: bool = False) -> dict[str, tuple]:
    """{column: (q1, q3)} with linear interpolation."""
    if not cols:
        return {}
    if not approx:
        return {c: tuple(q) if q else (None, None) for c, q in exact_quantiles(df, {c: as_double(c) for c in cols}, [0.25, 0.75]).items()}
    row = df.agg(*[F.percentile_approx(as_double(c), [0.25, 0.75], 10000).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"q{i}"][0], row[f"q{i}"][1]) if row[f"q{i}"] is not None else (None, None)
            for i, c in enumerate(cols)}


def iqr_fences(df: DataFrame, cols: list[str], multiplier: float = CONFIG.iqr_multiplier,
               approx: bool = False) -> dict[str, tuple]:
    """{column: (lower, upper)} Tukey fences."""
    out = {}
    for c, (q1, q3) in quartiles(df, cols, approx).items():
        if q1 is None:
            out[c] = (None, None)
        else:
            iqr = q3 - q1
            out[c] = (q1 - multiplier * iqr, q3 + multiplier * iqr)
    return out


def merge_one_row(frames: list[DataFrame]) -> DataFrame:
    """Side-by-side merge of one-row frames with distinct columns, without a join."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    cols = [c for f in frames for c in f.columns]
    return u.agg(*[F.max(c).alias(c) for c in cols])


def _empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


# ---------------------------------------------------------------- checks
def quality_missing(df: DataFrame) -> DataFrame:
    """Q5: columns with any missing value: count and % of rows (2 decimals)."""
    total = F.count(F.lit(1))
    out = long_agg(df, {c: {"missing_count": F.count_if(F.col(c).isNull()), "total": total} for c in df.columns})
    return (out.where(F.col("missing_count") > 0)
            .select("column_name", F.col("missing_count").cast("long").alias("missing_count"),
                    rnd(F.try_divide(F.col("missing_count") * 100.0, F.col("total")), 2).alias("missing_pct")))


def quality_duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Q6: rows after the first of each identical group (nulls equal), as count and %."""
    keys = subset or df.columns
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_count"),
        rnd(F.coalesce(F.try_divide(F.sum(F.col("n") - 1) * 100.0, F.sum("n")), F.lit(0.0)), 2)
        .alias("duplicate_pct"))


def quality_outliers(df: DataFrame, cols: list[str] | None = None,
                     multiplier: float = CONFIG.iqr_multiplier, approx: bool = False) -> DataFrame:
    """Q7: IQR outlier count, % and fences per numeric column with any outlier."""
    cols = cols or numeric_columns(df)
    if not cols:
        return _empty(df, "column_name string, outlier_count long, outlier_pct double, lower_bound double, upper_bound double")
    fences = iqr_fences(df, cols, multiplier, approx)
    total = F.count(F.lit(1))
    spec = {}
    for c in cols:
        lo, hi = fences[c]
        x = as_double(c)
        spec[c] = {"outlier_count": F.count_if((x < F.lit(lo)) | (x > F.lit(hi))) if lo is not None else F.lit(0).cast("long"),
                   "total": total,
                   "lower_bound": F.lit(lo).cast("double"), "upper_bound": F.lit(hi).cast("double")}
    out = long_agg(df, spec)
    return (out.where(F.col("outlier_count") > 0)
            .select("column_name", F.col("outlier_count").cast("long").alias("outlier_count"),
                    rnd(F.try_divide(F.col("outlier_count") * 100.0, F.col("total")), 2).alias("outlier_pct"),
                    rnd("lower_bound", 4).alias("lower_bound"), rnd("upper_bound", 4).alias("upper_bound")))


def quality_class_imbalance(df: DataFrame, target: str,
                            threshold: float = CONFIG.class_imbalance_ratio) -> DataFrame:
    """Q8: class counts with minority/majority ratio and the imbalance flag.

    The class table has one row per class; the ratio needs its max and min, which
    come from an aggregate of that small table (never a window over the data).
    """
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("class")) \
        .agg(F.count(F.lit(1)).alias("count"))
    mx, mn = counts.agg(F.max("count"), F.min("count")).first()
    ratio = round(mn / mx, 4) if mx else None
    return counts.select("class", "count", F.lit(ratio).cast("double").alias("minority_majority_ratio"),
                         F.lit(ratio is not None and ratio < threshold).alias("is_imbalanced"))


def corr_pairs(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, correlation) for every unordered column pair i < j, one aggregate."""
    cols = cols or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return _empty(df, "col_a string, col_b string, correlation double")
    one = df.agg(*[safe_corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{k}").alias("correlation"))
            for k, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*rows)))


def quality_high_corr(df: DataFrame, threshold: float = CONFIG.high_correlation) -> DataFrame:
    """Q9: pairs with |r| >= threshold, |r| rounded to 4."""
    return (corr_pairs(df).where(F.abs("correlation") >= threshold)
            .select("col_a", "col_b", rnd(F.abs("correlation"), 4).alias("correlation")))


def quality_dtype_issues(df: DataFrame, parse_share: float = 0.8) -> DataFrame:
    """Q10: text columns of which more than ``parse_share`` of all values are numbers, or are dates but no numbers."""
    cols = string_columns(df)
    if not cols:
        return _empty(df, "column_name string, issue string, parseable_pct double")
    shares = long_agg(df, {c: {
        "non_null": F.count(F.col(c)),
        "numbers": F.count_if(F.trim(F.col(c)).try_cast("double").isNotNull()),
        "dates": F.count_if(F.trim(F.col(c)).try_cast("double").isNull() & F.try_to_timestamp(F.col(c)).isNotNull())} for c in cols})
    shares = shares.where(F.col("non_null") > 0)
    number, date = F.col("numbers") / F.col("non_null"), F.col("dates") / F.col("non_null")
    return shares.where((number > parse_share) | (date > parse_share)).select(
        "column_name", F.when(number > parse_share, "Likely numeric stored as string").otherwise("Likely datetime stored as string").alias("issue"),
        rnd(F.greatest(number, date) * 100.0, 1).alias("parseable_pct"))


def quality_constant(df: DataFrame, low_share: float = CONFIG.low_variance) -> DataFrame:
    """Q11: constant (<= 1 distinct) columns, and near-constant text columns.

    Distinct values are only counted for text; for the others the extremes tell whether there is more than one.
    """
    from .profile import long_agg
    text = set(string_columns(df))
    rest = [c for c in df.columns if c not in text and not df.schema[c].dataType.simpleString().startswith(("array", "map", "struct", "variant"))]
    odd = [c for c in df.columns if c not in text and c not in rest]
    nd = distinct_counts(df, [*sorted(text), *odd]) if text or odd else None
    if rest:
        ends = long_agg(df, {c: {"n_distinct": F.when(F.count(F.col(c)) == 0, 0).when(F.min(c) == F.max(c), 1).otherwise(2).cast("long")} for c in rest})
        nd = ends.select("column_name", "n_distinct") if nd is None else nd.unionByName(ends.select("column_name", "n_distinct"))
    total = df.count()
    kinds = F.when(F.col("n_distinct") <= 1, "constant").when(
        F.col("column_name").isin(sorted(text) or [""]) & (F.col("n_distinct") / F.lit(max(total, 1)) < low_share),
        "near_constant")
    return (nd.select("column_name", F.col("n_distinct").alias("unique_values"), kinds.alias("kind"))
            .where(F.col("kind").isNotNull()))


def quality_high_cardinality(df: DataFrame, exact: bool = True) -> DataFrame:
    """Q12: text columns with > 50 / 100 / 1000 distinct values -> info / warning / critical."""
    cols = string_columns(df)
    if not cols:
        return _empty(df, "column_name string, unique_values long, severity string")
    from .profile import approx_distinct_counts
    nd = distinct_counts(df, cols) if exact else approx_distinct_counts(df, cols)
    sev = (F.when(F.col("n_distinct") > CONFIG.high_card_critical, "critical")
           .when(F.col("n_distinct") > CONFIG.high_card_warning, "warning")
           .when(F.col("n_distinct") > CONFIG.high_card_info, "info"))
    return nd.select("column_name", F.col("n_distinct").alias("unique_values"), sev.alias("severity")) \
        .where(F.col("severity").isNotNull())


def quality_issues(df: DataFrame, target: str | None = None) -> DataFrame:
    """Q13: the flat issue list (type, column, severity, count, pct)."""
    miss = quality_missing(df).select(
        F.lit("missing_values").alias("issue_type"), "column_name",
        F.when(F.col("missing_pct") > CONFIG.missing_critical_pct, "critical")
        .when(F.col("missing_pct") > CONFIG.missing_warn_pct, "warning").otherwise("info").alias("severity"),
        F.col("missing_count").alias("count"), F.col("missing_pct").alias("pct"))
    dup = quality_duplicates(df).where(F.col("duplicate_pct") > CONFIG.duplicate_warn_pct).select(
        F.lit("duplicates").alias("issue_type"), F.lit(None).cast("string").alias("column_name"),
        F.lit("warning").alias("severity"), F.col("duplicate_count").alias("count"), F.col("duplicate_pct").alias("pct"))
    card = quality_high_cardinality(df).select(
        F.lit("high_cardinality").alias("issue_type"), "column_name", "severity",
        F.col("unique_values").alias("count"), F.lit(None).cast("double").alias("pct"))
    out = quality_outliers(df).where(F.col("outlier_pct") > CONFIG.outlier_issue_pct).select(
        F.lit("outliers").alias("issue_type"), "column_name", F.lit("warning").alias("severity"),
        F.col("outlier_count").alias("count"), F.col("outlier_pct").alias("pct"))
    const = quality_constant(df).select(
        F.lit("constant_column").alias("issue_type"), "column_name", F.lit("info").alias("severity"),
        F.col("unique_values").alias("count"), F.lit(None).cast("double").alias("pct"))
    parts = [miss, dup, card, out, const]
    if target is not None:
        imb = quality_class_imbalance(df, target).agg(
            F.max("minority_majority_ratio").alias("r"), F.bool_or("is_imbalanced").alias("flag")) \
            .where(F.col("flag")).select(
                F.lit("class_imbalance").alias("issue_type"), F.lit(target).alias("column_name"),
                F.lit("warning").alias("severity"), F.lit(None).cast("long").alias("count"), F.col("r").alias("pct"))
        parts.append(imb)
    return reduce(DataFrame.unionByName, parts)


def quality_score(issues: DataFrame) -> DataFrame:
    """Q14: 100 - 15 per critical - 5 per warning - 1 per info, floor 0."""
    w = (F.when(F.col("severity") == "critical", CONFIG.penalty_critical)
         .when(F.col("severity") == "warning", CONFIG.penalty_warning).otherwise(CONFIG.penalty_info))
    return issues.agg(
        F.greatest(F.lit(0), F.lit(100) - F.coalesce(F.sum(w), F.lit(0))).cast("long").alias("quality_score"),
        F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.count_if(F.col("severity") == "warning").alias("n_warning"),
        F.count_if(F.col("severity") == "info").alias("n_info"))


def quality_report(df: DataFrame, target: str | None = None) -> DataFrame:
    """Q15: issues plus a final ``score`` row, one DataFrame."""
    w = (F.when(F.col("severity") == "critical", CONFIG.penalty_critical)
         .when(F.col("severity") == "warning", CONFIG.penalty_warning).otherwise(CONFIG.penalty_info)).cast("long")
    names = ["issue_type", "column_name", "severity", "count", "pct"]
    issues = quality_issues(df, target).select(*names, w.alias("w"))
    nothing = [F.lit(None).cast(issues.schema[c].dataType).alias(c) for c in names[1:]]
    score = lambda weight: F.struct(F.lit("score").alias("issue_type"), *nothing, weight.alias("w"))
    itself = F.struct(*names, F.lit(0).cast("long").alias("w"))
    # every issue is itself and adds its penalty to the score, so that the checks run once
    parts = issues.select(F.explode(F.array(itself, score(F.col("w")))).alias("r")).select("r.*").unionByName(
        df.sparkSession.range(1).select(score(F.lit(0).cast("long")).alias("r")).select("r.*"))
    final = F.when(F.col("issue_type") == "score", F.greatest(F.lit(0).cast("long"), 100 - F.col("w"))).otherwise(F.col("count"))
    return parts.groupBy(*names).agg(F.sum("w").alias("w")).select(*names[:3], final.alias("count"), "pct")


def missing_overall(df: DataFrame) -> DataFrame:
    """Q17: total missing cells, their % of all cells, and rows x columns."""
    n_cols = len(df.columns)
    miss = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    return df.agg(miss.cast("long").alias("missing_cells"), F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", "missing_cells", (F.col("n_rows") * n_cols).alias("total_cells"),
        rnd(F.try_divide(F.col("missing_cells") * 100.0, F.col("n_rows") * n_cols), 2).alias("missing_pct"))


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Q19: class counts, share, and max/min imbalance ratio."""
    counts = df.groupBy(F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    mx, mn, tot = counts.agg(F.max("count"), F.min("count"), F.sum("count")).first()
    return counts.select(
        "class", "count", rnd(F.col("count") * 100.0 / F.lit(tot), 2).alias("share_pct"),
        F.lit(round(mx / mn, 4) if mn else None).cast("double").alias("imbalance_ratio"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Q20: rows, columns, numeric / text column counts, missing cells, duplicate rows."""
    num, txt = numeric_columns(df), string_columns(df)
    miss = missing_overall(df).select("n_rows", "missing_cells", "missing_pct")
    dup = quality_duplicates(df)
    return merge_one_row([miss, dup]).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(len(num)).alias("n_numeric"),
        F.lit(len(txt)).alias("n_text"), "missing_cells", "missing_pct", "duplicate_count", "duplicate_pct")


def strong_correlations(df: DataFrame, threshold: float = 0.5, top: int | None = None) -> DataFrame:
    """Q18: pairs with |r| > threshold: all, or the ``top`` strongest."""
    pairs = corr_pairs(df).where(F.abs("correlation") > threshold)
    if top is not None:
        pairs = pairs.orderBy(F.desc(F.abs("correlation")), "col_a", "col_b").limit(top)
    return (pairs.select("col_a", "col_b", rnd("correlation", 4).alias("correlation"),
                    rnd(F.abs("correlation"), 4).alias("abs_correlation")))


def quality_delta(before: DataFrame, after: DataFrame, target: str | None = None) -> DataFrame:
    """Q22: score, issue count, missing cells and duplicate rows before and after a step."""
    def one(stage, df):
        score = quality_score(quality_issues(df, target)).select(
            "quality_score", (F.col("n_critical") + F.col("n_warning") + F.col("n_info")).alias("n_issues"))
        miss = missing_overall(df).select("missing_cells")
        dup = quality_duplicates(df).select("duplicate_count")
        return merge_one_row([score, miss, dup]).select(F.lit(stage).alias("stage"), "*")
    return one("before", before).unionByName(one("after", after))


def snapshot(df: DataFrame, order_by: str, target: str | None = None, n_samples: int = 3) -> DataFrame:
    """Q23: missing % and the first ``n_samples`` values (by ``order_by``) of every column.

    The samples are a per-column top-k over (order key, value), so no column's
    values are ever gathered in one task.
    """
    from ..functions.topk import top_k_per_group
    from .profile import unpivot_values
    cols = df.columns
    miss = quality_missing_all(df)
    vals = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), F.col(order_by).alias("ord"))
        for c in cols])).alias("p")).select("p.*").where(F.col("value").isNotNull())
    firsts = top_k_per_group(vals, ["column_name"], [F.asc("ord")], n_samples, salt_cols=["ord"], rank_col="rk")
    samples = firsts.groupBy("column_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rk", "value"))), lambda s: s["value"]), "|")
        .alias("sample_values"))
    out = miss.join(samples, "column_name", "left")
    if target is not None:
        n_target = df.agg(F.count_distinct(target)).first()[0]
        out = out.withColumn("target_distinct", F.lit(n_target).cast("long"))
    return out


def quality_missing_all(df: DataFrame) -> DataFrame:
    """Missing % of every column (zero included)."""
    total = F.count(F.lit(1))
    out = long_agg(df, {c: {"missing_count": F.count_if(F.col(c).isNull()), "total": total} for c in df.columns})
    return out.select("column_name",
                      rnd(F.try_divide(F.col("missing_count") * 100.0, F.col("total")), 2).alias("missing_pct"))
