"""Exact deduplication: a tree merge of sorted digest runs.

Rows are dealt into ``fan_in ** rounds`` runs by a hash of their id. A run is the
sorted list of distinct digests of its rows, each with the identifier that would
stay and the number of rows behind it; it is held as sorted arrays, one for each segment
of the digests' range (a segment has some ``each`` digests of the last run, so its number
grows with the table, and hashes spread evenly). In every round the segments of ``fan_in``
neighbouring runs are put one after the other and sorted, which for sorted runs is a merge (Spark's
sort finds them); equal entries are then neighbours, at most ``fan_in`` of them, and one linear
pass keeps the winning identifier and adds up the sizes. So a group of copies that holds a third
of all rows is at most one entry per run from the first (map-side combined) step on, and all
segments of the last, single run are merged by different tasks. The verdict then travels back
down: final run -> leaf runs -> rows, so that no join ever sees more rows of one digest than there are runs.

A digest is SHA-256 of the normalised text in UTF-8; every merge also compares an
independent 64-bit hash and the byte length, so two texts only count as equal when
all three agree.

Defined cases: a null text is the empty text; of equal texts the row with the
largest (``keep="max"``) or smallest (``"min"``) identifier stays, a null identifier
loses against any other; rows that repeat text *and* identifier are the same row and
share its verdict; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textfn import ascii_lower, free_name, let

KEY = ["_digest", "_check", "_bytes"]


def digests(df: DataFrame, id_col: str, text_col: str, n_runs: int) -> DataFrame:
    """One slim row per input row: identifier, leaf run, segment, digest and its checks."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (df.select(F.col(id_col).alias("_id"), ascii_lower(text).alias("_norm"))
            .select("_id", F.pmod(F.xxhash64("_id"), F.lit(n_runs)).cast("int").alias("_run"),
                    F.unhex(F.sha2(F.col("_norm"), 256)).alias("_digest"),
                    F.xxhash64(F.lit(7), "_norm").alias("_check"),
                    F.octet_length("_norm").cast("long").alias("_bytes")))


def sorted_runs(runs: DataFrame, segments: int, largest: bool) -> DataFrame:
    """Rows (_run, _seg, _entries): each run's segments as sorted arrays. Among equal digests the winner comes last, a null identifier first."""
    seg = F.floor(F.conv(F.hex(F.substring("_digest", 1, 4)), 16, 10).cast("long") * F.lit(segments) / F.lit(1 << 32)).cast("long")
    last = F.col("_keep").isNotNull() if largest else F.col("_keep").isNull()
    entry = F.struct(*KEY, last.alias("_known"), F.col("_keep"), F.col("_size"))
    return runs.groupBy("_run", seg.alias("_seg")).agg(F.sort_array(F.collect_list(entry)).alias("_entries"))  # some ``each`` entries


def merge_round(runs: DataFrame, fan_in: int, largest: bool) -> DataFrame:
    """Merge each ``fan_in`` neighbouring runs, segment by segment."""
    same = lambda a, b: F.coalesce((a["_digest"] == b["_digest"]) & (a["_check"] == b["_check"]) & (a["_bytes"] == b["_bytes"]), F.lit(False))

    def kept(entries):
        step = -1 if largest else 1  # from the winner to the other entries of its digest
        def winner(x, i):  # noqa: E306
            size = x["_size"]
            for j in range(1, fan_in):
                other = F.get(entries, i + step * j)
                size = size + F.when(same(other, x), other["_size"]).otherwise(F.lit(0))
            beyond = F.get(entries, i - step)
            return F.when(~same(beyond, x), F.struct(*[x[c].alias(c) for c in [*KEY, "_known", "_keep"]], size.alias("_size")))
        return F.filter(F.transform(entries, winner), lambda x: x.isNotNull())

    merged = F.sort_array(F.flatten(F.collect_list("_entries")))
    return (runs.groupBy(F.floor(F.col("_run") / fan_in).cast("int").alias("_run"), "_seg").agg(merged.alias("_entries"))
            .withColumn("_entries", let(F.col("_entries"), kept)))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                fan_in: int = 4, rounds: int = 3, each: int = 1000) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``."""
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    winner = F.max if keep == "max" else F.min
    scratch = Scratch(df.sparkSession, "exact-dedup")
    rows = scratch.keep(digests(df, id_col, text_col, fan_in ** rounds), "digests")
    runs = (rows.groupBy("_run", *KEY)
            .agg(winner("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")))
    runs = sorted_runs(runs, max(1, rows.count() // each), keep == "max")
    for _ in range(rounds):
        runs = merge_round(runs, fan_in, keep == "max")
    last = runs.select(F.explode("_entries").alias("e")).select(*[F.col(f"e.{c}") for c in [*KEY, "_keep", "_size"]])
    leaves = rows.select("_run", *KEY).distinct().join(last, KEY)
    return (rows.join(leaves, ["_run", *KEY])
            .select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"),
                    F.col("_size").cast("long").alias("group_size"),
                    F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
                    F.lower(F.hex("_digest")).alias("text_sha256")))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, all columns unchanged. Rows repeating text and identifier stay together."""
    kept = (exact_dedup(df, id_col, text_col, **options).where("kept")
            .select(F.col(id_col).alias("_k")).distinct())
    clash = free_name(df.columns, "_k")
    return df.join(kept.withColumnRenamed("_k", clash), F.col(id_col).eqNullSafe(F.col(clash)), "left_semi")
