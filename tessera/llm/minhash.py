"""Near-duplicates by min-max hashing, confirmed on the full shingle sets.

Each of ``perms`` permutations of the hashed shingles gives both its minimum and its
maximum: two signature values for one hash evaluation. A band is ``rows`` values of the
same kind from different permutations, so two texts of similarity J agree in a band with
probability J**rows, without bias. With 64 permutations there are 32 bands of 4: a pair at
J = 0.75 is missed with probability (1 - 0.75**4)**32 = 5e-6, one at 0.8 with 5e-8.

1. Texts with the same set are one class, found by a digest of the set; its smallest
   identifier stands for it. Copies are never paired.
2. The classes of a bucket (equal band) are compared with the bucket's smallest member:
   one pair for each member, not for each two. Confirmed pairs become links.
3. Buckets whose members are by now in one component need no more: further links could not
   change it. In the others, classes are left out whose shingles that other components have
   too are too few for any link (counted by shingle, so linear in the sets); the members
   that remain are compared across components inside a join that only returns links.
4. Links hold if 100 * intersection >= percent * union of the two full sets.

Every join is on identifiers or bands, with one row on one side for each key, so that
Spark can split hot keys; pairs whose set sizes rule out the similarity are left out early.

Defined cases: null or blank texts have an empty set and no links; a text of fewer than
``k`` words has one shingle, the whole; a null identifier never names a component; rows
that repeat an identifier are one node; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .shingles import mix, shingle_sets
from .textfn import free_name
from .worker import claim

#: Shingles hashed by all permutations at a time; passes over what may still link two components.
BLOCK, PRUNINGS = 1 << 14, 2
#: Texts of an Arrow batch that are Python strings at a time.
ROWS = 250


class MinMax:
    """Band hashes of a set of 64-bit shingle hashes."""

    def __init__(self, perms: int, rows: int, seed: int = 11):
        if perms % rows:
            raise ValueError("perms must be a multiple of rows")
        rng = np.random.Generator(np.random.PCG64(seed))
        self.times = (rng.integers(0, 1 << 32, perms, dtype=np.uint32) | np.uint32(1))[:, None]
        self.plus = rng.integers(0, 1 << 32, perms, dtype=np.uint32)[:, None]
        self.rows = rows
        self.salt = rng.integers(1, 1 << 64, (2 * perms // rows, rows), dtype=np.uint64) | np.uint64(1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """All minima, then all maxima."""
        low = np.full(len(self.times), 0xFFFFFFFF, np.uint32)
        high = np.zeros(len(self.times), np.uint32)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), BLOCK):
            values = short[at:at + BLOCK] * self.times + self.plus
            np.minimum(low, values.min(axis=1), out=low)
            np.maximum(high, values.max(axis=1), out=high)
        return np.concatenate((low, high))

    def bands(self, hashes: np.ndarray) -> np.ndarray:
        values = self.signature(hashes).reshape(-1, self.rows).astype(np.uint64)
        return mix((mix(values + self.salt) * self.salt).sum(axis=1, dtype=np.uint64)).view(np.int64)


FEATURES = "id {id}, n long, digest binary, bands array<bigint>"


def _features(df: DataFrame, id_col: str, text_col: str, k: int, perms: int, rows: int) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches):
        claim("minhash")
        hasher = MinMax(perms, rows)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, digest, bands = [], [], []
                for s in shingle_sets(part.column(1).to_pylist(), k):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bands.append(hasher.bands(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64()))], names=["id", "n", "digest", "bands"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, FEATURES.format(id=kind))


def _sets(df: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Rows (id, shingles): the full sets of the given identifiers."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches):
        claim("minhash")
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [s.view(np.int64) for s in shingle_sets(part.column(1).to_pylist(), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))],
                                                 names=["id", "shingles"])

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi")
    return texts.mapInArrow(work, f"id {kind}, shingles array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v) whose full sets are similar enough. Nothing is grouped after the joins, so that Spark can split a hot centre."""
    left = sets.select(F.col("id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (pairs.join(right, "v").join(left, "u")
            .select("u", "v", both.alias("both"), (F.size("a") + F.size("b")).alias("all"))
            .where(F.col("both") * 100 >= (F.col("all") - F.col("both")) * percent).select("u", "v"))


def _open(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    still = (members.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("n").alias("least"))
             .where("lo <> hi").select("band", "least"))
    return members.select("band", "rep", "n", "component").join(still, "band")


def _linkable(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Without the classes that cannot have a link to another component: a link needs an intersection of
    percent / (100 + percent) of both sizes, and only shingles that other components have too can be in it."""
    each = members.groupBy("rep", "n", "component").agg(F.min("least").alias("least"))
    shingles = each.join(sets, each["rep"] == sets["id"]).select("rep", "component", F.explode("shingles").alias("s"))
    crossing = shingles.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("s")
    common = shingles.select("rep", "s").join(crossing, "s").groupBy("rep").agg(F.count(F.lit(1)).alias("common"))
    other = F.greatest(F.col("least") * 100, F.col("n") * percent)  # hundredths of the size of the smallest partner
    able = each.join(common, "rep").where(F.col("common") * (100 + percent) * 100 >= (F.col("n") * 100 + other) * percent)
    return members.drop("least").join(able.select("rep"), "rep", "left_semi")


def _cross_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a bucket. The sets are compared inside the join, in the first
    bucket that two members share: pairs that are no link never become rows."""
    bands = members.groupBy("rep").agg(F.sort_array(F.collect_list("band")).alias("bands"))
    full = members.join(bands, "rep").join(sets, members["rep"] == sets["id"])
    side = lambda x: full.select(F.col("band").alias(f"band_{x}"), F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("component").alias(f"c_{x}"),
                                 F.col("bands").alias(f"bands_{x}"), F.col("shingles").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_u", "s_v"))
    sizes = F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent
    similar = both * (100 + percent) >= (F.col("n_u") + F.col("n_v")) * percent
    first = F.array_min(F.array_intersect("bands_u", "bands_v")) == F.col("band_u")
    return (side("u").join(side("v"), (F.col("band_u") == F.col("band_v")) & (F.col("c_u") < F.col("c_v"))
                           & F.when(~sizes, F.lit(False)).when(~first, F.lit(False)).otherwise(similar))
            .select("u", "v"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75,
               perms: int = 64, rows: int = 4) -> DataFrame:
    """One row per input row: ``id_col, n_shingles, component_id, kept``."""
    scratch = Scratch(df.sparkSession, "near-dedup")
    features = scratch.keep(_features(df, id_col, text_col, k, perms, rows), "features")
    classes = scratch.keep(features.where("n > 0").groupBy("digest", "n").agg(
        F.min("id").alias("rep"), F.first("bands").alias("bands")).where("rep is not null"), "classes")

    banded = classes.select("rep", "n", F.explode("bands").alias("band"))
    buckets = (banded.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("c"), F.max("rep").alias("top"))
               .where("c.rep <> top").select("band", F.col("c.rep").alias("centre"), F.col("c.n").alias("centre_n")))
    members = scratch.keep(banded.join(buckets, "band"), "members")
    fits = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    stars = (members.where("rep <> centre").where(fits(F.col("n"), F.col("centre_n")))
             .select(F.col("centre").alias("u"), F.col("rep").alias("v")).distinct())
    stars = scratch.keep(stars, "stars")
    ids = scratch.keep(members.select(F.col("rep").alias("id")).distinct(), "ids")
    sets = scratch.keep(_sets(df, ids, id_col, text_col, k), "sets")
    links = scratch.keep(_confirmed(stars, sets, percent), "links")
    joined = components(links, scratch)

    placed = members.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep"))
    rest = scratch.keep(_open(placed), "open0")
    for i in range(1, PRUNINGS + 1):
        rest = scratch.keep(_open(_linkable(rest, sets, percent)), f"open{i}")
    more = scratch.keep(_cross_links(rest, sets, percent), "more_links")
    if not more.isEmpty():  # what is joined already stands for its links
        joined = components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more), scratch, "final")
    joined = scratch.keep(joined, "joined")
    scratch.drop("members", "stars", "ids", "sets", "links", "more_links", *[f"open{i}" for i in range(PRUNINGS + 1)])

    named = scratch.keep(classes.select("digest", "n", "rep").join(
        joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "digest", F.col("n").alias("size"), F.coalesce("component", "rep").alias("component")), "named")
    return (features.select("id", "n", "digest")
            .join(named, (features["digest"] == named["digest"]) & (features["n"] == named["size"]), "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that stay, one of each component, all columns unchanged."""
    key = free_name(df.columns, "_kept_id")
    kept = near_dedup(df, id_col, **options).where("kept").select(F.col(id_col).alias(key)).distinct()
    return df.join(kept, F.col(id_col).eqNullSafe(F.col(key)), "left_semi")
