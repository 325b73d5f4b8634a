"""Single-pass column profiles (schema, describe, completeness, distinct counts).

Every report is one aggregate over all requested columns, reshaped to long form
(one row per column) with ``inline``. Nothing but the bounded one-row result of
an aggregate ever reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from ..functions.topk import top_k_per_group
from ..functions.quantiles import exact_quantiles
from ..functions.stats import (rnd, 
    as_double, dtype_group, is_numeric_type, numeric_columns, sample_skew, string_columns,
)


def long_agg(df: DataFrame, per_col: dict[str, dict[str, Column]], key: str = "column_name") -> DataFrame:
    """Evaluate ``{column: {stat: expr}}`` in ONE aggregate, return one row per column.

    All columns must declare the same stat names; each stat keeps one type.
    """
    if not per_col:
        raise ValueError("no columns to profile")
    names = list(next(iter(per_col.values())).keys())
    exprs = []
    for i, stats in enumerate(per_col.values()):
        if list(stats.keys()) != names:
            raise ValueError("every column needs the same statistics")
        exprs += [e.alias(f"s{i}_{s}") for s, e in stats.items()]
    one_row = df.agg(*exprs)
    rows = [F.struct(F.lit(c).alias(key), *[F.col(f"s{i}_{s}").alias(s) for s in names])
            for i, c in enumerate(per_col)]
    return one_row.select(F.inline(F.array(*rows)))


def unpivot_values(df: DataFrame, cols: list[str], as_type: str) -> DataFrame:
    """(column, value) pairs of the given columns, values cast to one type."""
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast(as_type).alias("value")) for c in cols
    ])).alias("p")).select("p.column_name", "p.value")


def value_counts_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n) for every distinct non-null value of every column.

    Integers and decimals are compared exactly (64-bit ids that differ by one are two values), floating
    columns as doubles (so -0.0 equals 0.0), the rest as text. Numbers are shown as doubles.
    The partial aggregate runs before the shuffle, so a value that holds a third of
    all rows costs one row per map task, not a hot reducer.
    """
    kinds: dict[str, list[str]] = {}  # columns by the type they are compared in
    other = []
    for c in cols:
        t = df.schema[c].dataType
        if not is_numeric_type(t):
            other.append(c)
        else:
            kinds.setdefault("bigint" if isinstance(t, IntegralType) else t.simpleString() if isinstance(t, DecimalType) else "double", []).append(c)
    parts = []
    for kind, some in kinds.items():
        parts.append(unpivot_values(df, some, kind).where(F.col("value").isNotNull())
                     .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
                     .select("column_name", F.col("value").cast("string").alias("value"), "n"))
    if other:
        parts.append(unpivot_values(df, other, "string").where(F.col("value").isNotNull())
                     .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    return reduce(DataFrame.unionByName, parts)


def distinct_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n_distinct) exact, nulls excluded, columns with no values give 0."""
    cols = cols or df.columns
    counted = value_counts_long(df, cols).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    spine = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
    return spine.join(counted, "column_name", "left").select(
        "column_name", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"))


def approx_distinct_counts(df: DataFrame, cols: list[str] | None = None, rsd: float = 0.02) -> DataFrame:
    """HyperLogLog++ distinct counts in a single pass, no shuffle of values."""
    cols = cols or df.columns
    return long_agg(df, {c: {"n_distinct": F.approx_count_distinct(c, rsd).cast("long")} for c in cols})


def schema_info(df: DataFrame) -> DataFrame:
    """Q1: one row per column with position, Spark type, dtype group, row and column count."""
    n = len(df.columns)
    spec = {f.name: {"position": F.lit(i), "spark_type": F.lit(f.dataType.simpleString()),
                     "dtype_group": F.lit(dtype_group(f.dataType)), "n_rows": F.count(F.lit(1)),
                     "n_columns": F.lit(n)}
            for i, f in enumerate(df.schema.fields)}
    return long_agg(df, spec).select("position", "column_name", "spark_type", "dtype_group", "n_rows", "n_columns")


def preview(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """Q2: first n rows by an explicit order (a top-k, not a scan of everything)."""
    return df.orderBy(*order_by).limit(n)


def describe_numeric(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Q3: count, mean, std (ddof 1), min, quartiles, max per numeric column."""
    cols = cols or numeric_columns(df)
    exact = {} if approx else exact_quantiles(df, {c: as_double(c) for c in cols}, [0.25, 0.5, 0.75])
    spec = {}
    for c in cols:
        x = as_double(c)
        q = (F.percentile_approx(x, [0.25, 0.5, 0.75], 10000) if approx
             else F.max(F.array(*[F.lit(v).cast("double") for v in exact[c] or [None] * 3])))
        spec[c] = {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x),
                   "min": F.min(x), "q": q, "max": F.max(x)}
    out = long_agg(df, spec)
    return out.select("column_name", "count", "mean", "std", "min",
                      F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
                      F.col("q")[2].alias("p75"), "max")


def describe_text(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Q3 (text): count, unique, top (most frequent, smallest on ties), freq."""
    cols = cols or string_columns(df)
    counts = value_counts_long(df, cols)
    top = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique"), F.sum("n").alias("count"))
    # most frequent value, smallest value on ties: min over (-n, value)
    best = counts.groupBy("column_name").agg(F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value"))).alias("b"))
    return (top.join(best, "column_name")
            .select("column_name", F.col("count").cast("long").alias("count"), F.col("unique").cast("long").alias("unique"),
                    F.col("b.value").alias("top"), (-F.col("b.neg_n")).cast("long").alias("freq")))


def column_completeness(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Q4: non-null, null and null % per column."""
    cols = cols or df.columns
    total = F.count(F.lit(1))
    out = long_agg(df, {c: {"non_null": F.count(F.col(c)), "total": total} for c in cols})
    return out.select("column_name", "non_null", (F.col("total") - F.col("non_null")).alias("nulls"),
                      rnd(F.try_divide((F.col("total") - F.col("non_null")) * 100.0, F.col("total")), 2)
                      .alias("null_pct"))


def profile_columns(df: DataFrame, top_k: int = 5) -> DataFrame:
    """Q16: null %, distinct, numeric moments with corrected skew; top-k values for text.

    Returns one row per column; ``top_values`` is an array of at most ``top_k`` values
    (ordered by count desc, value asc), built per column by a window over the
    already-aggregated (column, value, n) relation.
    """
    cols = df.columns
    num = numeric_columns(df)
    total = F.count(F.lit(1))
    spec = {}
    for c in cols:
        x = as_double(c) if c in num else None
        spec[c] = {
            "non_null": F.count(F.col(c)), "total": total,
            "mean": F.avg(x) if x is not None else F.lit(None).cast("double"),
            "std": F.stddev_samp(x) if x is not None else F.lit(None).cast("double"),
            "min": F.min(x) if x is not None else F.lit(None).cast("double"),
            "max": F.max(x) if x is not None else F.lit(None).cast("double"),
            "skew": sample_skew(x) if x is not None else F.lit(None).cast("double"),
        }
    base = long_agg(df, spec)
    counts = value_counts_long(df, cols)
    nd = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    text_cols = [c for c in cols if c not in num]
    ranked = top_k_per_group(counts.where(F.col("column_name").isin(text_cols) if text_cols else F.lit(False)),
                             ["column_name"], [F.desc("n"), F.asc("value")], top_k, salt_cols=["value"], rank_col="rk")
    top = (ranked.groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct("rk", "value"))).alias("t"))
           .select("column_name", F.transform("t", lambda s: s["value"]).alias("top_values")))
    return (base.join(nd, "column_name", "left").join(top, "column_name", "left")
            .select("column_name",
                    rnd(F.try_divide((F.col("total") - F.col("non_null")) * 100.0, F.col("total")), 2).alias("null_pct"),
                    F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"),
                    rnd("mean", 4).alias("mean"), rnd("std", 4).alias("std"),
                    rnd("min", 4).alias("min"), rnd("max", 4).alias("max"),
                    rnd("skew", 4).alias("skew"), F.array_join("top_values", "|").alias("top_values")))
