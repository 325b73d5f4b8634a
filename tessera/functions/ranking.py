"""Global row numbers and running sums without a single-task window.

Rows are range-partitioned on the order key and sorted inside each range; every row gets its
range id and its place in the range, and the frame is checkpointed *before* it is read twice
(once for the rows, once for the totals of the ranges). Spark samples the borders of a range
exchange anew whenever it is planned again, so ids and totals only agree on one materialised copy.
Only the totals table (one row per range) is global.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_PLACE = (1 << 33) - 1  # low bits of monotonically_increasing_id: the row's place in its partition


def ranged(df: DataFrame, order: list[Column], n_ranges: int | None = None) -> DataFrame:
    """``df`` with ``_rid`` (range id, ascending along ``order``) and ``_lr`` (1-based place in the range).

    Place and id come from the sorted partition itself, so no second exchange is needed for them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    n = n_ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
            .withColumn("_lr", F.monotonically_increasing_id())
            .withColumn("_rid", F.shiftright("_lr", 33).cast("int"))
            .withColumn("_lr", F.col("_lr").bitwiseAND(F.lit(_PLACE)) + 1)
            .checkpoint())


def global_row_number(df: DataFrame, order: list[Column], name: str = "rn",
                      n_ranges: int | None = None) -> DataFrame:
    """Append 1-based row numbers along ``order`` (which should be tie-free)."""
    local = ranged(df, order, n_ranges)
    sizes = local.groupBy("_rid").agg(F.max("_lr").alias("_n"))
    # window over at most n rows (one per range)
    offs = sizes.select("_rid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (local.join(F.broadcast(offs), "_rid")
            .select(*[F.col(c) for c in df.columns], (F.col("_off") + F.col("_lr")).alias(name)))


def global_prefix_sums(df: DataFrame, order: list[Column], sums: dict[str, Column],
                       n_ranges: int | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Running sums (first row .. current row along ``order``, optionally per group).

    A group holding a third of all rows spans several ranges; each range sums up locally, and the
    totals of the group's earlier ranges are added from a table with one row per (range, group).
    """
    pb = list(partition_by or [])
    spread = ranged(df, [*[F.col(c) for c in pb], *order], n_ranges)
    w = Window.partitionBy("_rid", *pb).orderBy("_lr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = spread.select("*", *[F.sum(e).over(w).alias(f"_cs_{k}") for k, e in sums.items()])
    tot = spread.groupBy("_rid", *pb).agg(*[F.sum(e).alias(f"_t_{k}") for k, e in sums.items()])
    before = Window.partitionBy(*pb).orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_rid", *[F.col(c).alias(f"_g_{c}") for c in pb],
                      *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums])
    same = local["_rid"] == offs["_rid"]
    for c in pb:  # a null group is a group
        same = same & local[c].eqNullSafe(offs[f"_g_{c}"])
    # without groups the offsets table has one row per range (bounded by n): broadcast it
    joined = local.join(F.broadcast(offs) if not pb else offs, same)
    return joined.select(*[local[c] for c in df.columns],
                         *[(F.col(f"_cs_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums])
