"""Mixing sources to target weights by a low-discrepancy schedule.

1. Targets: sources in code-point order (null last) get the weights in turn; each gets
   its share of all words, at most ``most`` times its own size; what that leaves over
   goes to the others by weight, until none is above.
2. Blocks: the documents of a source are put in a shuffled order (hash of id and seed)
   and their words form one stream, cut into blocks of ``block`` words (the last one
   takes the rest). Streams are summed up in hash-range pieces, so a source with a third
   of all documents is no single task.
3. Schedule: slot n lies at the golden-ratio point frac(n * 0.618...). The points are
   mapped through the sources' cumulative shares (a join on 65 536 cells of the unit
   interval), so that any stretch of the schedule has the sources in proportion. The
   slots of a source are ranked and take its blocks in turn, from the start again after
   the last one.
4. A document is taken as often as the slots use the blocks it lies in.

Everything is exact integer arithmetic on hashes and counts: reruns agree.

Defined cases: a null text has size 0, and a document of size 0 is never taken; a null
source is a source of its own, ordered last; repeated rows are documents of their own;
an empty table gives an empty result; only id, text and source columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .textfn import free_name

CELL_BITS, CHUNK_BITS, RANK_CHUNK, STEP = 16, 10, 8192, 1000
GOLDEN = 2654435769  # 2**32 divided by the golden ratio, odd


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def golden_point(n: Column) -> Column:
    """frac(n / golden ratio) as a 32-bit integer, without overflow."""
    low = F.pmod(n, F.lit(1 << 32))
    high = F.shiftright(low, 16).bitwiseAND(F.lit(65535))
    return F.pmod(F.pmod(high * F.lit(GOLDEN), F.lit(65536)) * F.lit(65536)
                  + low.bitwiseAND(F.lit(65535)) * F.lit(GOLDEN), F.lit(1 << 32))


def source_targets(sizes: DataFrame, weights: list[int], most: int, scratch: Scratch) -> DataFrame:
    """Rows (source, idx, weight, source_size, target), one for each source."""
    spark = sizes.sparkSession
    per_source = scratch.keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
    numbered = (per_source.sort(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
                .map(lambda r: (r[0][0], r[0][1], r[1])))
    schema = T.StructType([T.StructField("source", sizes.schema["source"].dataType),
                           T.StructField("source_size", T.LongType()), T.StructField("idx", T.LongType())])
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    table = scratch.keep(spark.createDataFrame(numbered, schema).withColumn(
        "weight", F.get(cycle, F.pmod("idx", F.lit(len(weights))).cast("int"))), "sources")
    cap = F.col("source_size") * F.lit(most)
    total, every = table.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (total or 0) / (every or 1), -1
    while True:  # each round caps at least one more source, or is the last
        over = cap < F.lit(level) * F.col("weight")
        n, held, free = table.agg(F.sum(over.cast("int")), F.sum(F.when(over, cap)),
                                  F.sum(F.when(~over, F.col("weight")))).first()
        if n is None or n == capped or not free:
            break
        capped, level = n, ((total or 0) - (held or 0)) / free
    return table.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))


def shares(sources: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Adds n_blocks and the interval [lo, hi) of 32-bit points of each source; the number of slots."""
    n_blocks = F.greatest(F.lit(1), F.floor(F.col("source_size") / F.lit(block))).cast("long")
    need = F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    # slots needed, in thousandths, so that the sums are integers
    table = (sources.withColumn("n_blocks", n_blocks).withColumn("need", F.round(need * 1000).cast("long"))
             .withColumn("step", F.floor(F.col("idx") / STEP)))
    steps = table.groupBy("step").agg(F.sum("need").alias("in_step"))
    before = F.sum("in_step").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    table = table.join(steps.select("step", F.coalesce(before, F.lit(0)).alias("earlier")), "step")
    within = F.sum("need").over(Window.partitionBy("step").orderBy("idx"))
    thousand = table.agg(F.sum("need")).first()[0] or 0
    to_point = lambda c: F.floor(c / F.lit(float(max(thousand, 1))) * F.lit(float(1 << 32))).cast("long")
    table = (table.withColumn("upto", F.col("earlier") + within)
             .withColumn("lo", to_point(F.col("upto") - F.col("need"))).withColumn("hi", to_point(F.col("upto"))))
    return table, round(thousand / 1000)


def schedule(sources: DataFrame, n_slots: int, most: int) -> DataFrame:
    """Rows (slot, idx, rank, block): which block of which source each slot takes."""
    spark = sources.sparkSession
    shift = 32 - CELL_BITS
    cells = (sources.where("hi > lo")
             .select("idx", "n_blocks", "lo", "hi",
                     F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))).alias("cell")))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u"))
    hits = (slots.withColumn("cell", F.shiftright("u", shift)).join(cells, "cell")
            .where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
            .select("slot", "idx", "n_blocks", F.floor(F.col("slot") / RANK_CHUNK).alias("part")))
    parts = hits.groupBy("idx", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("idx", "part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    local = F.row_number().over(Window.partitionBy("idx", "part").orderBy("slot")) - 1
    return (hits.withColumn("local", local).join(parts, ["idx", "part"])
            .withColumn("rank", F.col("earlier") + F.col("local"))
            .where(F.col("rank") < F.col("n_blocks") * most)
            .select("slot", "idx", "rank", F.pmod("rank", "n_blocks").alias("block")))


def streams(docs: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Adds idx, source_size, n_blocks, target and ``start``: words of the source's shuffled stream before the document."""
    rows = (docs.withColumn("_h", F.xxhash64(F.lit(seed), F.col("id")))
            .withColumn("_piece", F.shiftrightunsigned("_h", 64 - CHUNK_BITS)))
    known = sources.select(F.col("source").alias("_s"), "idx", "source_size", "n_blocks", "target")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    sums = rows.groupBy("idx", "_piece").agg(F.sum("size").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("idx").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("idx", "_piece", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    order = Window.partitionBy("idx", "_piece").orderBy("_h", "id", "size")
    local = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("_local", F.coalesce(local, F.lit(0))).join(sums, ["idx", "_piece"])
            .withColumn("start", F.col("earlier") + F.col("_local"))
            .drop("_h", "_piece", "_local", "earlier"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: list[int] = (5, 2, 1), most: int = 3, block: int = 64, seed: int = 20) -> DataFrame:
    """One row per input row: ``id_col, size, source_size, target, taken``."""
    scratch = Scratch(df.sparkSession, "mixing")
    docs = scratch.keep(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                  word_count(F.col(text_col)).alias("size")), "sizes")
    sources, n_slots = shares(source_targets(docs, list(weights), most, scratch), block)
    sources = scratch.keep(sources.drop("step", "earlier", "upto", "need"), "shares")
    rows = scratch.keep(streams(docs, sources, seed), "streams")
    uses = schedule(sources, n_slots, most).groupBy("idx", "block").agg(F.count(F.lit(1)).alias("uses"))
    size, last = F.col("size"), F.col("n_blocks") - 1
    block_of = lambda at: F.least(F.floor(at / F.lit(block)), last)
    pieces = (rows.where("size > 0").select(
        "idx", "start", "size", "n_blocks", "source_size",
        F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("start") + size - 1))).alias("block")))
    upto = F.when(F.col("block") == last, F.col("source_size")).otherwise((F.col("block") + 1) * block)
    words = F.least(F.col("start") + size, upto) - F.greatest(F.col("start"), F.col("block") * block)
    taken = (pieces.withColumn("words", words).join(uses, ["idx", "block"])
             .groupBy("idx", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken")))
    full = rows.where("size > 0").join(taken, ["idx", "start"], "left").unionByName(
        rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return full.select(F.col("id").alias(id_col), "size", "source_size", "target",
                       F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mixture itself: every document as often as the schedule takes it, to the nearest whole
    number, all columns unchanged. Identifiers must be unique."""
    plan = mix(df, id_col, **options).where("size > 0").select(
        F.col(id_col), F.round(F.col("taken") / F.col("size")).cast("int").alias("copies")).where("copies > 0")
    key, times, n = (free_name(df.columns, c) for c in ("_key", "_times", "_n"))
    plan = plan.withColumnsRenamed({id_col: key, "copies": times})
    return (df.join(plan, F.col(id_col).eqNullSafe(F.col(key))).select(
        *[df[c] for c in df.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(n)).drop(n))
