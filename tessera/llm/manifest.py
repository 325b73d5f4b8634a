"""Merkle manifest of a dataset by cogrouped subtree exchange.

A row's leaf is H (lowercase hex SHA-256; digests are hashed as hex text) of its listed columns, each
``-`` if null and else ``<UTF-8 bytes>:<value>``, so that no two different rows read alike. The rows
of a group form a tree: leaves in order of the identifier, every ``fan`` neighbours under one node,
until one node is left. The roots of the groups, ordered, form the tree above in the same way.

1. Leaves are ranked within their group by a range sort: a row's position is its place in the sorted
   range plus what earlier ranges hold of the group, so no group has to fit into one task.
2. ``fan ** height`` neighbours are a superblock: a subtree that one call reduces to its root. The roots
   of superblocks are the leaves of the next table, so a tree of n rows takes log(n) / height / log(fan) of these.
3. On the way back, the nodes of a superblock and the outer nodes that its proofs need (one row:
   the path from the superblock to the root of the dataset) are cogrouped by superblock. One call reduces
   the subtree, joins local and outer proof and, for leaves, folds the received leaf to a root.

A superblock has at most ``fan ** height`` rows and a path of log(n) levels, whatever the sizes of the
groups. Only the number of levels is known to the driver.

A path is text: its levels from the leaf up, joined by ``;``, each ``<place in the run>:<digests of the run's
others>``. A node without others is hashed alone, as its level then has more than this run.

Defined cases: null identifiers come first, equal ones are ordered by leaf; rows that repeat all listed
columns are leaves of their own with equal digests; a null group is a group, the first; groups are ordered
by the UTF-8 bytes of their value's text; empty and very long texts are hashed whole; a single leaf is its
group's root, a single group's root that of the dataset; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import ranged
from .scratch import Scratch

DIGEST = 64  # hex digits


def hashed(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def fold(digest: str, path: str) -> str:
    """The root that a leaf and its path lead to."""
    for level in path.split(";") if path else ():
        at, others = level.split(":")
        cut = int(at) * DIGEST
        digest = hashed(others[:cut], digest, others[cut:])
    return digest


def row_digest(values: dict[str, Column]) -> Column:
    """H of the values in order, each with its length in bytes."""
    text = [v.cast("string") for v in values.values()]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _levels(digests: list[str], first: bool, fan: int, height: int) -> list[list[str]]:
    """The levels of a superblock, leaves first. Only the first of a tree can be the whole tree, and then ends at one node."""
    out = [digests]
    while len(out) <= height and not (first and len(out[-1]) == 1):
        last = out[-1]
        out.append([hashed(*last[i:i + fan]) for i in range(0, len(last), fan)])
    return out


def _local_path(levels: list[list[str]], i: int, fan: int) -> str:
    steps = []
    for level in levels[:-1]:
        run = i // fan * fan
        steps.append(f"{i - run}:{''.join(level[run:i])}{''.join(level[i + 1:run + fan])}")
        i //= fan
    return ";".join(steps)


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``: the place, from 0, of each row within its ``tree`` along ``order``."""
    rows = ranged(nodes.withColumn("_tie", F.monotonically_increasing_id()), [F.col("tree"), *[F.asc_nulls_first(c) for c in order], F.col("_tie")])
    parts = rows.groupBy("_rid", "tree").agg(F.min("_lr").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("tree").orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_rid", "tree", (F.coalesce(earlier, F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(parts, ["_rid", "tree"]).withColumn("pos", F.col("_shift") + F.col("_lr")).drop("_rid", "_lr", "_shift", "_tie")


def climb(nodes: DataFrame, fan: int, height: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """``nodes`` (tree, pos, digest) and the tables of superblock roots above, up to one node for each tree."""
    def reduced(key, part):
        digests = part.sort_values("pos")["digest"].tolist()
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "digest": _levels(digests, key[1] == 0, fan, height)[-1]})

    tables = [nodes]
    while len(tables) == 1 or (tables[-1].agg(F.max("pos")).first()[0] or 0) > 0:
        blocks = tables[-1].select("tree", F.floor(F.col("pos") / fan ** height).alias("block"), "pos", "digest")
        tables.append(scratch.keep(blocks.groupBy("tree", "block").applyInPandas(
            reduced, "tree string, pos long, digest string"), f"{name}{len(tables)}"))
    return tables


def descend(nodes: DataFrame, outer: DataFrame, fan: int, height: int, carried: list[str], schema: str, finish) -> DataFrame:
    """Cogroup the nodes of each superblock with its row of ``outer`` (tree, pos, path, subroot, root).

    ``finish(part, path, subroot, root)`` makes the output columns of a superblock; ``path`` has one path, local and outer, for each node.
    """
    def exchanged(key, part, above):
        part = part.sort_values("pos")
        levels, beyond = _levels(part["digest"].tolist(), key[1] == 0, fan, height), above["path"].iloc[0]
        paths = [";".join(p for p in (_local_path(levels, i, fan), beyond) if p) for i in range(len(part))]
        return pd.DataFrame(finish(part, paths, above["subroot"].iloc[0], above["root"].iloc[0]))

    blocks = nodes.select("tree", F.floor(F.col("pos") / fan ** height).alias("block"), "pos", "digest", *carried)
    return (blocks.groupBy("tree", "block").cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block"))
            .applyInPandas(exchanged, schema))


def manifest(df: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang",
             received: dict[str, Column] | None = None, fan: int = 2, height: int = 8) -> DataFrame:
    """One row per input row: ``id_col, leaf, subroot, root, path, folded_root``.

    ``received`` has, by column, the values that some receiver holds; ``folded_root`` is the root that their leaf and the
    sender's path lead to. Without it the leaves themselves are folded.
    """
    scratch = Scratch(df.sparkSession, "manifest")
    sent = {c: df[c] for c in columns}
    changed = F.lit(False)
    for c, value in (received or {}).items():
        changed = changed | ~value.eqNullSafe(df[c])
    leaf = row_digest(sent)
    leaves = scratch.keep(df.select(
        df[id_col].alias("id"), F.coalesce(F.concat(F.lit("="), df[group_col].cast("string")), F.lit("-")).alias("tree"),
        leaf.alias("digest"), F.when(changed, row_digest({**sent, **(received or {})})).alias("got")), "leaves")
    leaves = scratch.keep(placed(leaves, ["id", "digest"]), "placed")
    lower = climb(leaves, fan, height, scratch, "lower")
    groups = lower[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    groups = scratch.keep(placed(groups, ["name"]), "groups")
    upper = climb(groups, fan, height, scratch, "upper")

    keep = "tree string, pos long, path string, subroot string, root string"
    def between(part, paths, subroot, root):  # noqa: E306
        return {"tree": part["tree"], "pos": part["pos"], "path": paths, "subroot": subroot, "root": root}
    def to_groups(part, paths, subroot, root):  # noqa: E306
        return {"tree": part["name"], "pos": 0, "path": paths, "subroot": part["digest"], "root": root}
    outer = upper[-1].select("tree", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for i, nodes in enumerate(reversed(upper[1:-1])):
        outer = scratch.keep(descend(nodes, outer, fan, height, [], keep, between), f"upper_paths{i}")
    outer = scratch.keep(descend(upper[0], outer, fan, height, ["name"], keep, to_groups), "group_paths")
    for i, nodes in enumerate(reversed(lower[1:-1])):
        outer = scratch.keep(descend(nodes, outer, fan, height, [], keep, between), f"lower_paths{i}")

    def finish(part, paths, subroot, root):
        start = part["got"].where(part["got"].notna(), part["digest"])
        return {"id": part["id"], "leaf": part["digest"], "subroot": subroot, "root": root, "path": paths,
                "folded_root": [fold(d, p) for d, p in zip(start, paths)]}
    kind = df.schema[id_col].dataType.simpleString()
    return descend(lower[0], outer, fan, height, ["id", "got"], f"id {kind}, leaf string, subroot string, root string, path string, folded_root string",
                   finish).withColumnRenamed("id", id_col)
