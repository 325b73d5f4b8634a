"""Cleaning operators: missing values, duplicates, outliers, type coercion.

Fitted values (means, medians, modes, fences) come from one aggregate whose
single row is applied as literals. Order-dependent operators take an explicit
``order_by`` (Spark rows have no inherent order).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.quantiles import exact_modes, exact_quantiles
from ..functions.ranking import ranged
from ..functions.stats import as_double, is_numeric_type, numeric_columns
from .quality import iqr_fences


# ---------------------------------------------------------------- missing values
def drop_missing(df: DataFrame, columns: list[str] | None = None, how: str = "any") -> DataFrame:
    """Drop rows with any / all nulls (NaN counts as null) in ``columns``."""
    if how not in ("any", "all"):
        raise ValueError(f"how must be 'any' or 'all', got {how!r}")
    return df.na.drop(how=how, subset=columns)


def _fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.select(*[
        F.coalesce(F.col(f.name), F.lit(values[f.name]).cast(f.dataType)).alias(f.name)
        if f.name in values and values[f.name] is not None else F.col(f.name)
        for f in df.schema.fields])


def impute_values(df: DataFrame, strategy: str, columns: list[str] | None = None) -> dict[str, object]:
    """Fit: {column: fill value} for mean / median / mode / zero."""
    cols = columns or df.columns
    num = [c for c in cols if is_numeric_type(df.schema[c].dataType)]
    if strategy == "zero":
        return {c: 0 for c in num}
    if strategy in ("mean", "median"):
        if not num:
            return {}
        if strategy == "median":
            return {c: q and q[0] for c, q in exact_quantiles(df, {c: as_double(c) for c in num}, [0.5]).items()}
        row = df.agg(*[F.avg(c).alias(f"v{i}") for i, c in enumerate(num)]).first()
        return {c: row[f"v{i}"] for i, c in enumerate(num)}
    if strategy == "mode":
        return exact_modes(df, cols)
    raise ValueError(f"unknown impute strategy {strategy!r}")


def impute(df: DataFrame, strategy: str, columns: list[str] | None = None,
           order_by: list[str] | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Mean / median / mode / zero / ffill / bfill.

    mean and median touch numeric columns only; zero fills numeric columns only
    (the text branch of the reference turns strings into mixed types); mode fills
    every column with its most frequent value, smallest on ties.
    """
    if strategy in ("ffill", "bfill"):
        if not order_by:
            raise ValueError(f"{strategy} needs order_by")
        return fill_directional(df, columns or df.columns, order_by, partition_by, backward=strategy == "bfill")
    if strategy == "median":  # only columns with a null need their median
        num = [c for c in columns or df.columns if is_numeric_type(df.schema[c].dataType)]
        found = df.agg(*[F.bool_or(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(num)]).first() if num else ()
        columns = [c for c, gap in zip(num, found) if gap]
        if not columns:
            return df
    return _fill(df, impute_values(df, strategy, columns))


def fill_directional(df: DataFrame, cols: list[str], order_by: list[str],
                     partition_by: list[str] | None = None, backward: bool = False,
                     n_ranges: int | None = None) -> DataFrame:
    """Carry the last (or next) non-null value along ``order_by``.

    With ``partition_by`` this is one window per key. Without it, a single global
    window would put every row in one task, so the rows are range-partitioned on
    the order key instead: each range fills locally, and the value that must cross
    a range border comes from a table of one row per range (size bounded by
    ``n_ranges``), joined back by range id.
    """
    # a backward fill is a forward fill along the reversed order
    order_fwd = [F.col(c).desc_nulls_last() if backward else F.col(c).asc_nulls_first() for c in order_by]
    frame = (Window.unboundedPreceding, Window.currentRow)
    if partition_by:
        w = Window.partitionBy(*partition_by).orderBy(*order_fwd).rowsBetween(*frame)
        return df.select(*[F.last(F.col(c), True).over(w).alias(c) if c in cols else F.col(c) for c in df.columns])
    spread = ranged(df, order_fwd, n_ranges)
    wl = Window.partitionBy("_rid").orderBy("_lr").rowsBetween(*frame)
    local = spread.select("*", *[F.last(F.col(c), True).over(wl).alias(f"_f_{c}") for c in cols])
    # last non-null value of each range, then the nearest earlier range's value (ranges are few)
    tails = spread.groupBy("_rid").agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_lr"))).alias(f"_t_{c}") for c in cols])
    wc = Window.orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select("_rid", *[F.last(F.col(f"_t_{c}"), True).over(wc).alias(f"_c_{c}") for c in cols])
    # carry has exactly one row per range id (n rows): a proven broadcast bound
    out = local.join(F.broadcast(carry), "_rid", "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"_f_{c}"), F.col(f"_c_{c}")).alias(c) if c in cols else F.col(c)
                        for c in df.columns])


# ---------------------------------------------------------------- duplicates
def drop_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str | bool = "first",
                    order_by: list[str] | None = None) -> DataFrame:
    """Keep the first / last row of each key under ``order_by``, or drop all repeated keys.

    Implemented as aggregations (``min_by`` / ``max_by`` / ``count``) so that the
    partial aggregate collapses a hot key on the map side; no window sorts a key group.
    """
    keys = subset or df.columns
    rest = [c for c in df.columns if c not in keys]
    if keep is False or keep == "none":
        g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"),
                                  *([F.first(F.struct(*rest)).alias("_r")] if rest else []))
        g = g.where(F.col("_n") == 1)
        return g.select(*keys, *([F.col(f"_r.{c}").alias(c) for c in rest]))
    if not rest:
        return df.dropDuplicates(keys)
    if not order_by:
        raise ValueError("keep='first'/'last' on a key subset needs order_by")
    ordk = F.struct(*[F.col(c) for c in order_by])
    pick = F.min_by if keep == "first" else F.max_by
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first', 'last' or False, got {keep!r}")
    g = df.groupBy(*keys).agg(pick(F.struct(*rest), ordk).alias("_r"))
    return g.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


# ---------------------------------------------------------------- outliers
def clip_outliers(df: DataFrame, columns: list[str] | None = None,
                  multiplier: float = CONFIG.iqr_multiplier, approx: bool = False) -> DataFrame:
    """Clip numeric columns to their IQR fences; NULL stays NULL."""
    cols = columns or numeric_columns(df)
    fences = iqr_fences(df, cols, multiplier, approx)

    def clip(c: str) -> Column:
        lo, hi = fences[c]
        x = as_double(c)
        return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi))).alias(c)
    return df.select(*[clip(c) if c in fences and fences[c][0] is not None else F.col(c) for c in df.columns])


def remove_outliers(df: DataFrame, columns: list[str] | None = None,
                    multiplier: float = CONFIG.iqr_multiplier, approx: bool = False) -> DataFrame:
    """Keep rows inside the fences of every column (a NULL in a tested column drops the row)."""
    cols = columns or numeric_columns(df)
    fences = iqr_fences(df, cols, multiplier, approx)
    conds = [F.coalesce(as_double(c).between(F.lit(lo), F.lit(hi)), F.lit(False))
             for c, (lo, hi) in fences.items() if lo is not None]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


# ---------------------------------------------------------------- columns and types
def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """C11: drop the named columns that exist."""
    return df.drop(*[c for c in columns if c in df.columns])


def to_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Coerce to double; unparseable text becomes NULL."""
    return df.select(*[F.trim(F.col(c).cast("string")).try_cast("double").alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def to_datetime(df: DataFrame, columns: list[str], fmt: str | None = None) -> DataFrame:
    """Coerce to timestamp; unparseable text becomes NULL."""
    def conv(c):
        s = F.col(c).cast("string")
        return (F.try_to_timestamp(s, F.lit(fmt)) if fmt else F.try_to_timestamp(s)).alias(c)
    return df.select(*[conv(c) if c in columns else F.col(c) for c in df.columns])


def to_category(df: DataFrame, columns: list[str]) -> DataFrame:
    """C14: categorical = string in Spark (parquet dictionary-encodes it)."""
    return df.select(*[F.col(c).cast("string").alias(c) if c in columns else F.col(c) for c in df.columns])


CLEAN_ACTIONS = {
    "drop_missing": drop_missing, "impute": impute, "drop_duplicates": drop_duplicates,
    "clip_outliers": clip_outliers, "remove_outliers": remove_outliers, "drop_columns": drop_columns,
    "convert_to_numeric": to_numeric, "convert_to_datetime": to_datetime, "convert_to_category": to_category,
}


def apply_steps(df: DataFrame, steps: list[dict], actions: dict = CLEAN_ACTIONS) -> DataFrame:
    """Fold ``[{"action": ..., "params": {...}}]`` over the frame.

    Every action is validated before any plan is built; an unknown action raises.
    """
    for s in steps:
        if s.get("action") not in actions:
            raise ValueError(f"unknown action {s.get('action')!r}")
    return reduce(lambda d, s: actions[s["action"]](d, **s.get("params", {})), steps, df)


def step_log(df: DataFrame, steps: list[dict], actions: dict = CLEAN_ACTIONS) -> DataFrame:
    """Row and column counts after every step (one count job per step)."""
    rows, cur = [], df
    before = cur.count()
    for i, s in enumerate(steps):
        cur = apply_steps(cur, [s], actions)
        after = cur.count()
        rows.append((i, s["action"], before, after, before - after, len(cur.columns)))
        before = after
    return df.sparkSession.createDataFrame(
        rows, "step int, action string, rows_before long, rows_after long, rows_removed long, n_columns int")
