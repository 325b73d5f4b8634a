"""Whitening of embeddings by their leading principal components, found by FEAST contour integration.

1. Entries become whole numbers, ``floor(scale * c) + offset``. Each distinct vector counts once: a vector
   that a third of all rows share is one row from the map-side step on.
2. Tasks add up sums, and then products of what is left after subtracting the rounded mean. These are whole
   numbers that a double holds exactly, added up as decimals, so the covariance is exact before its one rounding.
3. Inertia counts (signs of the pivots of the shifted covariance, by Sylvester's law) place a lower edge below the wanted
   eigenvalues and cut the range above it into slices of a few eigenvalues each.
4. Each slice is a Spark row of its own. FEAST projects a random block onto the slice's eigenspace by Gauss-Legendre
   quadrature, on the circle around the slice, of solves with the complex shifted covariance; Rayleigh-Ritz extracts values and
   vectors, and both repeat until the residuals are at rounding level. A slice that finds more or fewer than its
   inertia count is tried with a larger block, and an error in the end: none is missed silently.
5. Rows are projected in Arrow batches. The covariance of the projected distinct vectors gives the identity error.

The driver and each task hold the dimension x dimension covariance (``most`` dimensions, 8 MB) and no rows.

Defined cases: rows whose vector is null, holds a null or non-finite entry, or one whose whole number is beyond 2**52, are left
out; so are those of another length than most (the longer of two as frequent ones). Directions without variance (1e-13 of the
largest eigenvalue or less) are no components, so there may be fewer than asked for: none if all vectors are equal or empty.
Equal eigenvalues give some orthonormal basis of their space. A deviation beyond a long is null. Rows that repeat an
identifier each get theirs, a null identifier stays null, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

EXACT, ROWS, EPS = 1 << 52, 1000, float(np.finfo(float).eps)


@dataclass
class Model:
    """Components in order of falling variance, as columns of ``vectors``; ``sums`` over the ``n`` fitted vectors."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


def whole(df: DataFrame, id_col: str, vec_col: str, scale: int, offset: int) -> DataFrame:
    """Rows (id, x) of those that count."""
    c = F.col("v")
    fine = F.col("v").isNotNull() & F.coalesce(F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= EXACT / scale)), F.lit(False))
    return (df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(fine)
            .select("id", F.transform("v", lambda e: (F.floor(e * scale) + offset).cast("long")).alias("x")))


def _matrix(batch: pa.RecordBatch, d: int):
    """Blocks of rows of a batch, with their vectors as a matrix."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part, part.column("x").flatten().to_numpy().reshape(part.num_rows, d)


def _summed(fit: DataFrame, d: int, width: int, block) -> np.ndarray:
    """Sum over all vectors of ``block(matrix)``, an array of whole numbers of ``width`` columns, as Python integers."""
    def partial(batches):
        total = 0
        for batch in batches:
            for _, x in _matrix(batch, d):
                total = total + np.array([[int(v) for v in row] for row in block(x)], object)
        if not np.isscalar(total):
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in total.ravel()])],
                                             names=["i", "j", "v"])

    rows = (fit.mapInArrow(partial, "i int, j int, v string").groupBy("i", "j")
            .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())  # one row for each entry
    out = np.zeros((1 + max((r.i for r in rows), default=-1), width), object)
    for r in rows:
        out[r.i, r.j] = int(r.v)
    return out


def covariance(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Number of vectors, sums, and the covariance (divisor n), rounded once."""
    n = fit.count()
    sums = _summed(fit, d, d, lambda x: x.sum(axis=0)[None])[0].tolist()
    centre = np.array([(2 * s + n) // (2 * n) for s in sums])

    def products(x):
        rest = (x - centre).astype(float)
        return rest.T @ rest
    gram = _summed(fit, d, d, products)
    left = [s - n * int(c) for s, c in zip(sums, centre)]
    v = np.array([[float(Fraction(n * gram[i, j] - left[i] * left[j], n * n)) for j in range(d)] for i in range(d)])
    return n, sums, v


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues are above ``shift``: positive pivots of v - shift, by complete 1 x 1 and 2 x 2 pivoting."""
    a, count = v - shift * np.eye(len(v)), 0
    tiny = EPS * max(np.abs(v).max(initial=0.0), abs(shift), 1e-300)
    while len(a):
        diagonal = np.abs(a.diagonal())
        k = int(diagonal.argmax())
        off = np.abs(a - np.diag(a.diagonal()))
        if diagonal[k] >= 0.64 * off.max():
            pivot = a[k, k] if diagonal[k] > tiny else -tiny
            count += int(pivot > 0)
            rest = np.delete(a[k], k)
            a = np.delete(np.delete(a, k, 0), k, 1) - np.outer(rest, rest) / pivot
        else:  # such a block has one positive and one negative eigenvalue
            both = list(np.unravel_index(int(off.argmax()), off.shape))
            count += 1
            block, rest = a[np.ix_(both, both)], np.delete(a[both], both, 1)
            a = np.delete(np.delete(a, both, 0), both, 1) - rest.T @ np.linalg.solve(block, rest)
            a = (a + a.T) / 2
    return count


def slices(v: np.ndarray, wanted: int, each: int = 6) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues in it) that hold the ``wanted`` largest eigenvalues with variance."""
    top = float(np.abs(v).sum(axis=1).max(initial=0.0)) * 1.01
    if not top:
        return []
    floor = top * 1e-13
    wanted = min(wanted, above(v, floor))
    low, high = floor, top
    while wanted and above(v, low) > wanted and high - low > 1e-10 * top:
        middle = (low + high) / 2
        low, high = (middle, high) if above(v, middle) >= wanted else (low, middle)

    def clear(edge: float) -> float:
        """About the middle of the gap between eigenvalues that holds ``edge``: projections converge slowly next to an edge."""
        n, reach = above(v, edge), []
        for way in (-1, 1):
            step = 1e-12 * top
            while 0 < edge + way * step < top and above(v, edge + way * step) == n:
                step *= 8
            reach.append(way * step / 8)
        return min(max(edge + sum(reach) / 2, floor), top)

    def cut(a, n_a, b, n_b):
        if n_a - n_b <= each or b - a <= 1e-7 * top:
            return [(a, b, n_a - n_b)] if n_a > n_b else []
        m = clear((a + b) / 2)
        n_m = above(v, m)
        return cut(a, n_a, m, n_m) + cut(m, n_m, b, n_b) if a < m < b else [(a, b, n_a - n_b)]

    low = clear(low)
    step = top - low
    while step > 1e-12 * top and not above(v, low + step / 2):  # the norm may be far above the largest eigenvalue
        step /= 2
    top = low + step
    return cut(low, above(v, low), top, 0) if wanted else []


def feast(v: np.ndarray, low: float, high: float, count: int, nodes: int = 12, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in (low, high) and their unit eigenvectors."""
    d, centre, radius = len(v), (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(nodes)
    turns = np.exp(0.5j * np.pi * (1 - points))
    size, norm = count + count // 2 + 4, np.abs(v).max()
    for _ in range(3):
        block = np.random.Generator(np.random.PCG64(7)).standard_normal((d, min(d, size)))
        best = np.inf
        for _ in range(rounds):
            projected = sum((w / 2 * radius * t * np.linalg.solve((centre + radius * t) * np.eye(d) - v, block)).real
                            for w, t in zip(weights, turns))
            basis, _ = np.linalg.qr(projected)
            values, small = np.linalg.eigh(basis.T @ v @ basis)
            block = basis @ small
            inside = (values > low) & (values < high)
            residual = np.abs(v @ block[:, inside] - block[:, inside] * values[inside]).max(initial=0.0)
            if inside.sum() == count and (residual <= 4 * EPS * norm or best <= 1e3 * EPS * norm and residual >= best / 2):
                return values[inside], block[:, inside] / np.linalg.norm(block[:, inside], axis=0)
            best = residual if inside.sum() == count else np.inf
        size *= 2
    raise ArithmeticError(f"between {low} and {high}, inertia counts {count} components; {int(inside.sum())} found, residual {residual}")


def components(spark, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues with variance, falling, and eigenvectors (columns); each slice is a task."""
    parts = slices(v, wanted)
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))
    shared = spark.sparkContext.broadcast(v)

    def solve(frames):
        for frame in frames:
            for low, high, count in frame.itertuples(index=False):
                values, vectors = feast(shared.value, low, high, int(count))
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    tasks = spark.createDataFrame(parts, "low double, high double, n long").repartition(len(parts))
    found = sorted(tasks.mapInPandas(solve, "value double, vector array<double>").collect(), key=lambda r: -r.value)[:wanted]
    vectors = np.array([r.vector for r in found]).T
    turned = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(found))] < 0
    return np.array([r.value for r in found]), np.where(turned, -vectors, vectors)


def _project(x: np.ndarray, model: Model, centre: np.ndarray) -> np.ndarray:
    left = np.array([float(Fraction(s - model.n * int(c), model.n)) for s, c in zip(model.sums, centre)])
    return ((x - centre).astype(float) - left) @ (model.vectors / np.sqrt(model.values))


def identity_error(fit: DataFrame, model: Model, centre: np.ndarray) -> float:
    """Largest absolute entry of the projected vectors' covariance minus the identity."""
    d, k = len(centre), len(model.values)

    def partial(batches):
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, x in _matrix(batch, d):
                y = _project(x, model, centre)
                sums, products = sums + y.sum(axis=0), products + y.T @ y
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                          pa.array(np.vstack([products, sums]).ravel())], names=["i", "j", "v"])

    out = np.zeros((k + 1, k))
    for r in fit.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v / model.n
    return float(np.abs(out[:k] - np.outer(out[k], out[k]) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", wanted: int = 16, scale: int = 64,
           offset: int = 1_000_000, most: int = 1024) -> tuple[DataFrame, Model | None]:
    """One row per remaining row (``id_col, deviation, whitened``: array of up to ``wanted`` numbers), and the fitted model."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "whitening")
    kind = df.schema[id_col].dataType.simpleString()
    rows = scratch.keep(whole(df, id_col, vec_col, scale, offset), "whole")
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = usual.d if usual else 0
    if d > most:
        raise ValueError(f"vectors of {d} dimensions; a covariance of {most} at most is kept in one task")
    schema = f"id {kind}, deviation long, whitened array<double>"
    if not d:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col), None
    rows = rows.where(F.size("x") == d)
    fit = scratch.keep(rows.select("x").distinct(), "fit")
    n, sums, v = covariance(fit, d)
    values, vectors = components(spark, v, wanted)
    model = Model(n, sums, values, vectors, float(v.trace()))
    if not len(values):
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col), model
    centre = np.array([(2 * s + n) // (2 * n) for s in sums])
    model.identity_error = identity_error(fit, model, centre)
    left = np.array([s - n * int(c) for s, c in zip(sums, centre)])

    def deviations(x):
        rest = x - centre
        if (n * float(np.abs(rest).max(initial=0)) + n) ** 2 * d < 2.0 ** 62:
            return ((n * rest - left) ** 2).sum(axis=1).tolist()
        exact = [sum((n * int(e) - int(s)) ** 2 for e, s in zip(row, left)) for row in rest]
        return [e if e < 1 << 63 else None for e in exact]

    def projected(batches):
        for batch in batches:
            for part, x in _matrix(batch, d):
                y = _project(x, model, centre)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(deviations(x), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))],
                    names=["id", "deviation", "whitened"])

    return rows.select("id", "x").mapInArrow(projected, schema).withColumnRenamed("id", id_col), model
