"""Column expressions shared by the operators.

All of them stay inside Catalyst (no Python per row) and are ANSI-safe:
no expression here throws on bad data, a zero divisor or a constant column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType,
    LongType, NumericType, ShortType, StringType, TimestampNTZType, TimestampType,
)

INTEGRAL = (ByteType, ShortType, IntegerType, LongType)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_numeric_type(dt) -> bool:
    return isinstance(dt, NumericType) and not isinstance(dt, BooleanType)


def numeric_columns(df, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in exclude]


def string_columns(df, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in exclude]


def datetime_columns(df, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (TimestampType, TimestampNTZType, DateType)) and f.name not in exclude]


def dtype_group(dt) -> str:
    """Coarse dtype family used by schema reports."""
    if isinstance(dt, BooleanType):
        return "bool"
    if isinstance(dt, INTEGRAL):
        return "integer"
    if isinstance(dt, (FloatType, DoubleType, DecimalType)):
        return "float"
    if isinstance(dt, (TimestampType, TimestampNTZType, DateType)):
        return "datetime"
    if isinstance(dt, StringType):
        return "string"
    return "other"


def as_double(c) -> Column:
    return col_(c).cast("double")


def clean_float(c) -> Column:
    """NaN and +-inf become NULL (the reference treats them as missing)."""
    x = as_double(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None).cast("double")).otherwise(x)


def pair_complete(a, b) -> tuple[Column, Column]:
    """Null each side unless both values are present (pairwise-complete statistics)."""
    a, b = as_double(a), as_double(b)
    return F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)


def safe_corr(a, b) -> Column:
    """Pearson r that is NULL (not an exception) for constant or empty inputs."""
    x, y = pair_complete(a, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def sample_skew(c) -> Column:
    """Bias-corrected skewness G1 (NULL below 3 values, 0 for a constant)."""
    x = as_double(c)
    n = F.count(x).cast("double")
    g1 = F.coalesce(F.skewness(x), F.lit(0.0))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(c) -> Column:
    """Bias-corrected excess kurtosis G2 (NULL below 4 values, 0 for a constant)."""
    x = as_double(c)
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.coalesce(corrected, F.lit(0.0)))


def floor_mod(a, b) -> Column:
    """Modulo whose sign follows the divisor; NULL for a zero divisor."""
    a, b = as_double(a), as_double(b)
    return a - b * F.floor(F.try_divide(a, b))


def word_count(c) -> Column:
    """Whitespace-separated word count (like Python ``str.split()``): blank text has 0 words."""
    return F.regexp_count(col_(c), F.lit(r"\S+"))


def rnd(c, digits: int = 4) -> Column:
    """Round half away from zero on the scaled binary value: round(x * 10^d) / 10^d.

    Spark's ``round`` rounds the shortest decimal text of x, which differs from
    rounding the binary value when that text ends in a tie digit; scaling first
    makes every engine that computes in IEEE doubles agree.
    """
    m = float(10 ** digits)
    return F.round(col_(c).cast("double") * F.lit(m), 0) / F.lit(m)


def pct(num, den, digits: int = 2) -> Column:
    return rnd(F.try_divide(col_(num) * F.lit(100.0), col_(den)), digits)


def round_half_away(x: float | None, digits: int = 4) -> float | None:
    """Driver-side twin of ``rnd`` for scalars: round(x * 10^d) half away from zero, / 10^d."""
    import math
    if x is None or (isinstance(x, float) and (math.isnan(x) or math.isinf(x))):
        return x
    m = float(10 ** digits)
    r = abs(x) * m
    f = math.floor(r)
    v = f + 1.0 if r - f >= 0.5 else float(f)
    return math.copysign(v, x) / m if v else 0.0
