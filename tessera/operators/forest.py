"""Isolation forest: many small trees grown on hashed samples, all rows scored.

A tree sees ``sample`` rows, chosen by a hash of id and tree, so a rerun and a rerun of a lost task choose the same. A first filter
keeps some more than that per tree, then the smallest hashes are taken; each tree is grown by one task on its own sample of fixed
size. The forest is ``trees`` x 2 * ``sample`` numbers whatever the table's size, and is sent to the tasks that score the rows batch by batch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.stats import as_double

EULER = 0.5772156649015329


def expected_path(n):
    """Mean depth of a value in a random tree of ``n`` values."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, seed: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, threshold, size) of the nodes of one tree; the children of i are 2i + 1 and 2i + 2."""
    rng = np.random.Generator(np.random.PCG64(seed))
    nodes = 2 ** (depth + 1) - 1
    feature, threshold, size = np.full(nodes, -1, np.int32), np.zeros(nodes), np.zeros(nodes)
    todo = [(0, x, 0)]
    while todo:
        i, part, level = todo.pop()
        size[i] = len(part)
        spread = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 else []
        if level == depth or not len(spread):
            continue
        f = int(rng.choice(spread))
        low, high = part[:, f].min(), part[:, f].max()
        feature[i], threshold[i] = f, low + (high - low) * rng.random()
        left = part[:, f] <= threshold[i]
        todo += [(2 * i + 1, part[left], level + 1), (2 * i + 2, part[~left], level + 1)]
    return feature, threshold, size


def _standardised(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Rows (id, x) without nulls, standardised (ddof 0)."""
    full = df.select(F.col(id_col).alias("id"), *[as_double(c).alias(f"v{i}") for i, c in enumerate(columns)]).na.drop(
        subset=[f"v{i}" for i in range(len(columns))])
    s = full.agg(*[e for i in range(len(columns)) for e in (F.avg(f"v{i}").alias(f"m{i}"), F.stddev_pop(f"v{i}").alias(f"s{i}"))]).first()
    return full.select("id", F.array(*[(F.col(f"v{i}") - F.lit(s[f"m{i}"] or 0.0)) / F.lit(s[f"s{i}"] or 1.0) for i in range(len(columns))]).alias("x"))


def _forest(rows: DataFrame, n: int, trees: int, sample: int, seed: int):
    """(features, thresholds, leaf depths) of all trees as matrices, and the sample size."""
    size = min(sample, n)
    depth = max(math.ceil(math.log2(max(size, 2))), 1)
    rate = min(1.0, (size + 6 * math.sqrt(size) + 10) / max(n, 1))
    place = lambda t: F.xxhash64(F.lit(seed), "id", t)
    picked = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), place(t).alias("h"))),
                      lambda p: F.pmod(p["h"], F.lit(1 << 30)) < F.lit(math.ceil(rate * (1 << 30))))
    chosen = rows.select("x", "id", F.explode(picked).alias("p")).select("x", "id", "p.*")
    first = F.row_number().over(Window.partitionBy("tree").orderBy(F.pmod("h", F.lit(1 << 30)), "h", "id", "x"))
    chosen = chosen.withColumn("r", first).where(F.col("r") <= size).select("tree", "x", "r")

    def grow(key, part):
        x = np.array(part.sort_values("r")["x"].tolist())
        feature, threshold, counts = _grow(x, seed * 1_000_003 + int(key[0]), depth)
        return pd.DataFrame({"tree": [key[0]], "feature": [feature], "threshold": [threshold], "size": [counts]})

    grown = chosen.groupBy("tree").applyInPandas(grow, "tree int, feature array<int>, threshold array<double>, size array<double>").collect()
    grown.sort(key=lambda r: r.tree)
    level = np.floor(np.log2(np.arange(2 ** (depth + 1) - 1) + 1))
    return (np.array([r.feature for r in grown]), np.array([r.threshold for r in grown]),
            np.array([level + expected_path(r.size) for r in grown]), size, depth)


def _filled(forest) -> list:
    """Trees whose leaves hand their path down to all nodes below, so that a row may go on either way to the last level."""
    out = []
    for f, t, p in zip(*forest[:3]):
        p, ended = p.copy(), f < 0
        for i in range((len(f) - 1) // 2):
            if ended[i]:
                ended[[2 * i + 1, 2 * i + 2]], p[[2 * i + 1, 2 * i + 2]] = True, p[i]
        out.append((np.maximum(f, 0), t, p))
    return out


def _score(x: np.ndarray, trees: list, size: int, depth: int) -> np.ndarray:
    """2 ** -(mean path / expected path) of each row of ``x``: near 1 for rows that are soon alone."""
    total, flat, start = np.zeros(len(x)), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for f, t, p in trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (flat[start + f[node]] > t[node])
        total += p[node]
    return 2.0 ** (-(total / max(len(trees), 1)) / max(float(expected_path(size)), 1e-9))


def _scores_side_by_side(rows: DataFrame, forests: list, d: int, kind: str) -> DataFrame:
    """(id, scores): the score by each of ``forests``, which are (columns of x it reads, forest)."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)

    def scored(batches):
        filled = [(at, _filled(forest), *forest[3:]) for at, forest in shared.value]
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, d)
            values = np.column_stack([_score(x[:, at], *forest) for at, *forest in filled])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(values), pa.list_(pa.float64()))], names=["id", "scores"])

    return rows.mapInArrow(scored, f"id {kind}, scores array<double>")


def _scores(rows: DataFrame, forest, d: int, kind: str) -> DataFrame:
    """(id, score) of one forest on all columns."""
    return _scores_side_by_side(rows, [(list(range(d)), forest)], d, kind).select("id", F.get("scores", F.lit(0)).alias("score"))


def isolation_forest(df: DataFrame, id_col: str, columns: list[str], contamination: float = 0.05, trees: int = 100, sample: int = 256,
                     seed: int = 42) -> DataFrame:
    """A4: (id, score, is_anomaly) of rows without nulls in ``columns``; anomalies are the ``contamination`` share of highest scores."""
    rows = _standardised(df, id_col, columns)
    n = rows.count()
    kind = df.schema[id_col].dataType.simpleString()
    if not n:
        return df.sparkSession.createDataFrame([], f"{id_col} {kind}, score double, is_anomaly boolean")
    scores = _scores(rows, _forest(rows, n, trees, sample, seed), len(columns), kind)
    cut = exact_quantiles(scores, {"score": F.col("score")}, [1 - contamination])["score"][0]
    return scores.select(F.col("id").alias(id_col), "score", (F.col("score") > F.lit(cut)).alias("is_anomaly"))


def feature_contributions(df: DataFrame, id_col: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """A4: (column_name, contribution): correlation of each column's own forest (half the trees) with that of all columns."""
    rows = _standardised(df, id_col, columns)
    n = rows.count()
    kind = df.schema[id_col].dataType.simpleString()
    if not n:
        return df.sparkSession.createDataFrame([(c, None) for c in columns], "column_name string, contribution double")
    forests = [(list(range(len(columns))), _forest(rows, n, trees, sample, seed))]
    for i in range(len(columns)):
        single = rows.select("id", F.array(F.get("x", F.lit(i))).alias("x"))
        forests.append(([i], _forest(single, n, max(trees // 2, 1), sample, seed)))
    d = len(columns)
    # one pass, all scores of a row together: nothing is joined
    scores = _scores_side_by_side(rows, forests, d, kind).where(F.col("id").isNotNull()).select("id", *[F.get("scores", F.lit(i)).alias(f"s{i}") for i in range(d + 1)])
    if rows.groupBy("id").count().where("id IS NOT NULL AND count > 1").limit(1).count():
        # scores meet by id: each of an id's m scores by one forest with each of its scores by the others
        m = F.col("m").cast("double")
        ids = scores.groupBy("id").agg(F.count(F.lit(1)).alias("m"), *[e for i in range(d + 1) for e in (F.sum(f"s{i}").alias(f"t{i}"), F.sum(F.col(f"s{i}") ** 2).alias(f"q{i}"))])
        t = ids.agg(F.sum(m ** (d + 1)).alias("n"), *[e for i in range(d + 1) for e in (
            F.sum(m ** d * F.col(f"t{i}")).alias(f"x{i}"), F.sum(m ** d * F.col(f"q{i}")).alias(f"xx{i}"), F.sum(m ** (d - 1) * F.col("t0") * F.col(f"t{i}")).alias(f"xy{i}"))]).first()
        spread = [max(t[f"xx{i}"] - t[f"x{i}"] ** 2 / t["n"], 0.0) for i in range(d + 1)]
        both = [math.sqrt(spread[0] * s) for s in spread[1:]]
        found = [abs(t[f"xy{i + 1}"] - t["x0"] * t[f"x{i + 1}"] / t["n"]) / w if w else None for i, w in enumerate(both)]
        return df.sparkSession.createDataFrame(list(zip(columns, found)), "column_name string, contribution double")
    r = scores.agg(*[F.abs(F.corr("s0", f"s{i + 1}")).alias(f"c{i}") for i in range(d)]).first()
    return df.sparkSession.createDataFrame([(c, r[f"c{i}"]) for i, c in enumerate(columns)], "column_name string, contribution double")
