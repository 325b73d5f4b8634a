"""Domain checks of a table and the automatic fixes before training."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from ..functions.stats import is_numeric_type
from .encode import label_encode
from .features import date_numeric
from .profile import long_agg
from .quality import quality_duplicates

# Words in a column's name that say its numbers are not negative, and the limits in percent.
POSITIVE_WORDS = ["price", "quantity", "amount", "salary", "revenue", "age", "sqft", "weight", "distance"]
MISSING_PCT, SMALLEST_CLASS_PCT, MOST_CLASSES = 30.0, 5.0, 20

_DATES = (DateType, TimestampType, TimestampNTZType)


def domain_checks(df: DataFrame, as_of: str, target: str | None = None) -> DataFrame:
    """Q21: (check, severity, column_name, count, pct) of every check that fails.

    One aggregate serves all columns; ``as_of`` is the time after which a date lies in the future.
    Constant columns are found from minimum, maximum and null count, without a distinct count.
    """
    total = F.count(F.lit(1))
    spec = {}
    for f in df.schema.fields:
        c, zero = F.col(f.name), F.lit(0).cast("long")
        named = any(w in f.name.lower() for w in POSITIVE_WORDS)
        spec[f.name] = {
            "missing": F.count_if(c.isNull()), "total": total,
            "negative": F.count_if(c < 0) if is_numeric_type(f.dataType) and named else F.max(zero),
            "future": F.count_if(c.cast("timestamp") > F.lit(as_of).cast("timestamp")) if isinstance(f.dataType, _DATES) else F.max(zero),
            "same": F.coalesce(F.min(c.cast("string")).eqNullSafe(F.max(c.cast("string"))), F.lit(True))
                    & ((F.count_if(c.isNull()) == 0) | (F.count(c) == 0)),
        }
    per = long_agg(df, spec)
    def found(check, severity, when, count):  # noqa: E306
        return per.where(when).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "column_name",
                                      count.cast("long").alias("count"), F.round(count * 100.0 / F.col("total"), 2).alias("pct"))
    parts = [
        found("high_missing", "warning", F.col("missing") * 100.0 / F.col("total") > MISSING_PCT, F.col("missing")),
        found("negative_values", "error", F.col("negative") > 0, F.col("negative")),
        found("future_dates", "warning", F.col("future") > 0, F.col("future")),
        found("constant_column", "info", F.col("same"), F.col("total")),
    ]
    empty = F.lit(None).cast("string").alias("column_name")
    parts.append(quality_duplicates(df).where("duplicate_count > 0").select(
        F.lit("duplicate_rows").alias("check"), F.lit("warning").alias("severity"), empty,
        F.col("duplicate_count").cast("long").alias("count"), F.col("duplicate_pct").alias("pct")))
    if target is not None:
        sizes = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
        worst = sizes.agg(F.min("n").alias("least"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes"))
        parts.append(worst.where((F.col("classes") <= MOST_CLASSES) & (F.col("least") * 100.0 / F.col("all") < SMALLEST_CLASS_PCT)).select(
            F.lit("class_imbalance").alias("check"), F.lit("warning").alias("severity"), F.lit(target).alias("column_name"),
            F.col("least").alias("count"), F.round(F.col("least") * 100.0 / F.col("all"), 2).alias("pct")))
    return reduce(DataFrame.unionByName, parts)


def auto_fix(df: DataFrame, problem: str, columns: list[str]) -> DataFrame:
    """Make the named columns usable for training.

    ``high_cardinality``: label codes; ``datetime_columns``: calendar parts and epoch seconds;
    ``non_numeric_columns``: dates to epoch seconds, text to label codes, anything else dropped.
    Columns that do not exist are ignored, unless none exists.
    """
    there = [c for c in columns if c in df.columns]
    if not there:
        raise ValueError("none of the columns exists")
    if problem == "high_cardinality":
        return label_encode(df, there)
    if problem == "datetime_columns":
        return date_numeric(df, there)
    if problem != "non_numeric_columns":
        raise ValueError(f"unknown problem {problem!r}")
    types = {f.name: f.dataType for f in df.schema.fields}
    dates = [c for c in there if isinstance(types[c], _DATES)]
    texts = [c for c in there if isinstance(types[c], StringType)]
    numbers = [c for c in there if is_numeric_type(types[c])]
    rest = [c for c in there if c not in dates + texts + numbers]
    out = label_encode(df, texts) if texts else df
    for c in dates:
        seconds = F.unix_micros(F.col(c).cast("timestamp_ntz").cast("timestamp")) / 1e6
        out = out.withColumn(f"{c}_ordinal", seconds).drop(c)
    return out.drop(*rest)
