"""Exact top-k per group that never sorts one whole group in one task.

Rows are first ranked inside (group, salt) buckets, where the salt is a hash of
a tie-free row key; only the best k of each bucket survive, and the final rank
runs over at most ``k * buckets`` rows per group. The union of per-bucket top-k
always contains the global top-k, so the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    salt_cols: list[str] | None = None, buckets: int = 64,
                    rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of every group under ``order`` (which must be tie-free)."""
    salt_cols = salt_cols or [c for c in df.columns if c not in group_cols]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_cols), F.lit(buckets)))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    pre = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*order) if group_cols else Window.orderBy(*order)
    return pre.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)
