"""Domain feature recipes (RFM, ratios, recency decay, rolling sensors, group statistics,
temporal flags) as joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import as_double, rnd


def rfm(orders: DataFrame, customer: str, ts: str, amount: str, reference_date: str) -> DataFrame:
    """Recency (days before the reference date), frequency, monetary per customer."""
    ref = F.to_date(F.lit(reference_date))
    return orders.groupBy(customer).agg(
        F.datediff(ref, F.to_date(F.max(ts))).alias("recency_days"), F.count(F.lit(1)).alias("frequency"),
        rnd(F.sum(as_double(amount)), 4).alias("monetary"))


def spend_segment(df: DataFrame, column: str, labels=("Low", "Medium", "High", "Premium")) -> DataFrame:
    """Quantile segments of a spend column (right-closed quartile bins)."""
    from .features import bin_quantile
    return bin_quantile(df, column, len(labels), list(labels)).withColumnRenamed(f"{column}_bin", "segment")


def price_features(df: DataFrame, price: str, quantity: str, discount: str) -> DataFrame:
    """Unit price, price x discount, log unit price."""
    unit = F.try_divide(as_double(price), F.nullif(as_double(quantity), F.lit(0.0)))
    return df.select("*", rnd(unit, 4).alias("unit_price"), rnd(unit * as_double(discount), 4).alias("price_x_discount"),
                     rnd(F.log1p(F.greatest(unit, F.lit(0.0))), 4).alias("log_price"))


def domain_ratios(df: DataFrame, ratios: dict[str, tuple[str, str]], flags: dict[str, str] | None = None) -> DataFrame:
    """Named ratios (NULL for a zero denominator) and boolean flags given as SQL expressions."""
    cols = [rnd(F.try_divide(as_double(a), F.nullif(as_double(b), F.lit(0.0))), 4).alias(n) for n, (a, b) in ratios.items()]
    cols += [F.expr(e).alias(n) for n, e in (flags or {}).items()]
    return df.select("*", *cols)


def composite_score(df: DataFrame, columns: list[str], name: str = "composite") -> DataFrame:
    """Mean of min-max scaled components (nulls skipped)."""
    from .encode import scale_fit
    fit = scale_fit(df, columns, "minmax")
    scaled = [F.when(F.col(c).isNotNull(), (as_double(c) - F.lit(fit[c][0])) / F.lit(fit[c][1])) for c in columns]
    arr = F.filter(F.array(*scaled), lambda v: v.isNotNull())
    return df.select("*", rnd(F.try_divide(F.aggregate(arr, F.lit(0.0), lambda a, v: a + v), F.size(arr).cast("double")), 4)
                     .alias(name))


def recency_decay(df: DataFrame, ts: str, reference_date: str, rate: float = 0.01) -> DataFrame:
    """Days since the event and exp(-rate * days)."""
    days = F.datediff(F.to_date(F.lit(reference_date)), F.to_date(F.col(ts)))
    return df.select("*", days.alias("days_since"), rnd(F.exp(-F.lit(rate) * days), 6).alias("decay"))


def prior_visits(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Number of earlier events of the same key, by time (then ``tie``).

    A running count per key over range partitions of (key, time), so one very active key
    is spread over several tasks.
    """
    from ..functions.ranking import global_prefix_sums
    out = global_prefix_sums(df, [F.col(ts).asc(), F.col(tie).asc()], {"_k": F.lit(1)}, partition_by=[key])
    return out.select(*df.columns, (F.col("_k") - 1).alias("prior_visits"))


def rolling_stats(s: DataFrame, key: str, lags=(1, 6, 24), window: int = 24) -> DataFrame:
    """Lags and trailing mean / max of a regular series (key, ts, value)."""
    w = Window.partitionBy(key).orderBy("ts")
    fr = w.rowsBetween(-(window - 1), 0)
    return s.select(key, "ts", "value", *[rnd(F.lag("value", k).over(w), 4).alias(f"lag_{k}") for k in lags],
                    rnd(F.avg("value").over(fr), 4).alias(f"rolling_mean_{window}"),
                    rnd(F.max("value").over(fr), 4).alias(f"rolling_max_{window}"))


def group_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Group median and mean joined back, and the value's difference from the group mean."""
    g = df.groupBy(group).agg(F.percentile(as_double(value), 0.5).alias("group_median"),
                              F.avg(as_double(value)).alias("group_mean"))
    out = df.join(g, group, "left")
    return out.select(*df.columns, rnd("group_median", 4).alias("group_median"), rnd("group_mean", 4).alias("group_mean"),
                      rnd(as_double(value) - F.col("group_mean"), 4).alias("diff_from_group_mean"))


def group_percentile(df: DataFrame, group: str, value: str) -> DataFrame:
    """Percent rank of the value inside its group: (rank - 1) / (n - 1).

    Rank comes from counting, per group, the rows with a smaller value: rows are first
    reduced to (group, value, count), then running counts are taken over that reduced
    table, so a hot group's raw rows are never sorted in one task.
    """
    from ..functions.ranking import global_prefix_sums
    v = df.groupBy(group, as_double(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    cum = global_prefix_sums(v, [F.col("_v").asc()], {"_cum": F.col("_c")}, partition_by=[group])
    sizes = v.groupBy(group).agg(F.sum("_c").alias("_n"))
    ranks = cum.join(sizes, group).select(group, "_v", (F.col("_cum") - F.col("_c")).alias("_below"), "_n")
    out = df.withColumn("_v", as_double(value)).join(ranks, [group, "_v"], "left")
    pr = F.when(F.col("_n") > 1, F.col("_below") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    return out.select(*df.columns, rnd(pr, 4).alias("percent_rank"))


def temporal_flags(df: DataFrame, ts: str, holidays: DataFrame | None = None, peak_hours=(9, 17)) -> DataFrame:
    """Hour, day of week (Mon=0), weekend, peak hour, holiday (holiday table joined by date)."""
    out = df.select("*", F.hour(ts).alias("hour"), F.weekday(ts).alias("dayofweek"),
                    (F.weekday(ts) >= 5).alias("is_weekend"),
                    F.hour(ts).between(peak_hours[0], peak_hours[1] - 1).alias("is_peak_hour"),
                    F.to_date(ts).alias("_d"))
    if holidays is not None:
        h = holidays.select(F.col("date").alias("_d"), F.lit(True).alias("_h")).distinct()
        out = out.join(h, "_d", "left")
        return out.select(*df.columns, "hour", "dayofweek", "is_weekend", "is_peak_hour",
                          F.coalesce("_h", F.lit(False)).alias("is_holiday"))
    return out.drop("_d")
