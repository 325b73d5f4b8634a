"""Tree regressors fitted on cells of binned features.

MLlib's trees look at a row only through the bins of its features (at most ``maxBins`` each) and, of the labels in a node, at
their count, sum and sum of squares. Rows that share all bins, a cell, can thus be summed up once before the first tree. The
bin borders are MLlib's own (same sample, same rule); a cell with n rows becomes two weighted points at mean +- deviation, which
have the same three sums, so MLlib's estimators grow on them the trees they would grow on the rows. Boosting too: what the
trees so far predict is one value a cell. A forest's bootstrap is drawn row by row before the rows are summed up.
"""

from __future__ import annotations

import math
from itertools import accumulate, batched

from pyspark.ml import Pipeline
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

#: Rows a cell from which a model is fitted on cells; with fewer, passes over the rows cost less. A forest has one fit a tree on cells.
LEAST = {"decision_tree": 32, "gradient_boosting": 32, "random_forest": 1000}
MOST_CELLS, SAMPLE = 1 << 20, 10_000
BLOCK = 5  # bootstraps summed up in one pass: with more, the generated method is too long for the JVM to compile


def plain(df: DataFrame, features: list[str]) -> bool:
    """Whether each feature is one number without attributes (those of a categorical column change how MLlib splits it)."""
    return all(isinstance(df.schema[c].dataType, (NumericType, BooleanType)) and "ml_attr" not in df.schema[c].metadata for c in features)


def split_points(counts: dict[float, float], expected: float, seen: int, bins: int) -> list[float]:
    """MLlib's borders of one feature: between all values if they are few, else between groups of about equal size.

    ``counts`` leaves out zeros, whose count is what is missing to ``expected`` rows; ``seen`` is the number of counted values."""
    total = sum(counts.values())
    if counts and expected - total > 2.0 ** -52 * seen * 100:
        counts = {**counts, 0.0: expected - total}
    values = sorted(counts)
    between = [(a + b) / 2.0 for a, b in zip(values, values[1:])]
    if len(between) <= bins - 1:
        return between
    stride = expected / bins
    out, target = [], stride
    sums = list(accumulate(counts[v] for v in values))
    for border, before, after in zip(between, sums, sums[1:]):
        if abs(before - target) < abs(after - target):
            out.append(border)
            target += stride
    return out


def borders(train: DataFrame, features: list[str], rows: int, seed: int, max_bins: int = 32) -> list[list[float]]:
    """Bin borders of each feature, from the rows that MLlib's tree learners draw for them (all, or about 10 000 of a larger table)."""
    spark = train.sparkSession
    wanted, bins = max(max_bins * max_bins, SAMPLE), min(max_bins, rows)
    cols = train.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    fraction = wanted / rows if wanted < rows else 1.0
    if fraction < 1.0:
        draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        cols = DataFrame(spark._jsparkSession.createDataFrame(cols._jdf.toJavaRDD().sample(False, fraction, draw), cols._jdf.schema()), spark)
    found = cols.collect()
    out = []
    for i in range(len(features)):
        counts: dict[float, float] = {}
        for r in found:
            if r[i] is not None and r[i] != 0.0 and math.isfinite(r[i]):  # others end the fit later
                counts[r[i]] = counts.get(r[i], 0.0) + 1.0
        cuts = split_points(counts, fraction * rows, int(sum(counts.values())), bins)
        out.append(sorted({c for c in cuts if math.isfinite(c)}))
    return out


def _poisson(u, mean: float):
    """Poisson number (of ``mean`` at most 1) of a uniform u, by the inverse of its distribution."""
    p, below, steps = math.exp(-mean), 0.0, []
    while p > 1e-17:
        below += p
        steps.append(below)
        p *= mean / len(steps)
    out = F.when(u < steps[0], 0.0)
    for k, s in enumerate(steps[1:], 1):
        out = out.when(u < s, float(k))
    return out.otherwise(float(len(steps)))


class Cells:
    """Sums of the training rows by cell, and the tree regressors fitted on them.

    ``trees`` bootstraps are drawn as MLlib draws them, a Poisson number (of ``mean``) for each row and tree, seeded by partition,
    but with other random numbers: a forest differs from the one on the rows as those of two partitionings or seeds do."""

    def __init__(self, train: DataFrame, features: list[str], label: str, cuts: list[list[float]], seed: int, trees: int = 0, mean: float = 1.0):
        self.features, self.cuts, self.trees = features, cuts, trees
        self.size = math.prod(len(c) + 1 for c in cuts)
        self.names = [f"b{i}" for i in range(len(features))]
        bad = F.lit(False)
        for c in (*features, label):
            v = F.col(c).cast("double")
            bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        checked = train.where(F.when(bad, F.raise_error(F.lit("features and label of training rows must not be null, NaN or infinite")).cast("boolean"))
                              .otherwise(True))
        rows = self.with_cell(checked).select("_cell", F.col(label).cast("double").alias("y"))
        self.all_rows = self._sums(rows.withColumn("w0", F.lit(1.0)), 1)
        self.drawn = []
        for block in batched(range(trees), BLOCK):
            draws = rows.select("_cell", "y", *[F.rand(seed + (t << 32)).alias(f"u{i}") for i, t in enumerate(block)])
            draws = draws.select("_cell", "y", *[_poisson(F.col(f"u{i}"), mean).alias(f"w{i}") for i in range(len(block))])
            self.drawn.append(self._sums(draws, len(block)))

    def _sums(self, rows: DataFrame, n: int) -> DataFrame:
        """Weight n, sum s and sum of squares q of the labels of each cell, for the weights w0, w1, ..."""
        y = F.col("y")
        aggs = [a for i in range(n) for w in (F.col(f"w{i}"),)
                for a in (F.sum(w).alias(f"n{i}"), F.sum(w * y).alias(f"s{i}"), F.sum(w * y * y).alias(f"q{i}"))]
        return rows.groupBy("_cell").agg(*aggs).coalesce(1 + self.size // 50_000).persist()

    def close(self) -> None:
        for f in (self.all_rows, *self.drawn):
            f.unpersist()

    def with_cell(self, df: DataFrame) -> DataFrame:
        """``df`` with the number of a row's cell, its bins as digits. A value is in the bin after the borders below it, NaN and null in the last."""
        x = [F.col(c).cast("double") for c in self.features]
        df = df.withColumns({f"_x{i}": F.when(v.isNull() | F.isnan(v), float("inf")).otherwise(v) for i, v in enumerate(x)})
        cut = [i for i, c in enumerate(self.cuts) if c]
        if cut:  # a bucket holds its lower end, a bin its upper end
            ends = [[-math.inf, *[math.nextafter(b, math.inf) for b in self.cuts[i]], math.inf] for i in cut]
            df = Bucketizer(splitsArray=ends, inputCols=[f"_x{i}" for i in cut], outputCols=[f"_b{i}" for i in cut]).transform(df)
        cell = F.lit(0).cast("long")
        for i in cut:
            cell = cell * (len(self.cuts[i]) + 1) + F.col(f"_b{i}").cast("long")
        return df.withColumn("_cell", cell).drop(*[f"_x{i}" for i in range(len(x))], *[f"_b{i}" for i in cut])

    def _bins(self):
        """Columns b0, b1, ... of a cell, counted from 1: MLlib infers the number of zeros instead of counting them."""
        out, below = [], self.size
        for name, cut in zip(self.names, self.cuts):
            below //= len(cut) + 1
            out.append((F.floor(F.col("_cell") / below) % (len(cut) + 1) + 1).cast("double").alias(name))
        return out

    def _fit(self, est, sums: DataFrame, i: int):
        """MLlib's estimator on the points; ``maxBins`` so large that each bin stays one and all points are looked at for the borders between them."""
        n, s, q = (F.col(f"{k}{i}") for k in "nsq")
        d = F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / n)
        points = sums.where(n > 0).select((n / 2).alias("w"), F.explode(F.array(s / n - d, s / n + d)).alias("y"), *self._bins())
        bins = max(est.getMaxBins(), math.isqrt(2 * self.size) + 1, *[len(c) + 1 for c in self.cuts])
        est = est.copy({est.weightCol: "w", est.labelCol: "y", est.maxBins: bins})
        return Pipeline(stages=[VectorAssembler(inputCols=self.names, outputCol=est.getFeaturesCol()), est]).fit(points)

    def predict(self, est, test: DataFrame) -> DataFrame:
        """``test`` with column ``prediction`` of the tree regressor ``est`` fitted on the training rows."""
        grid = test.sparkSession.range(0, self.size, 1, 1 + self.size // 50_000).select(F.col("id").alias("_cell")).select("_cell", *self._bins())
        if est.hasParam("bootstrap"):
            subset = est.getFeatureSubsetStrategy()
            if subset == "auto":
                subset = "onethird" if est.getNumTrees() > 1 else "all"
            one = est.copy({est.numTrees: 1, est.bootstrap: False, est.subsamplingRate: 1.0, est.featureSubsetStrategy: subset})
            for t in range(self.trees):
                tree = one.copy({one.seed: est.getSeed() + t, one.predictionCol: f"p{t}"})
                grid = self._fit(tree, self.drawn[t // BLOCK], t % BLOCK).transform(grid).drop(est.getFeaturesCol())
            prediction = sum((F.col(f"p{t}") for t in range(self.trees)), F.lit(0.0)) / self.trees
        else:
            grid, prediction = self._fit(est, self.all_rows, 0).transform(grid), F.col("prediction")
        return self.with_cell(test).join(F.broadcast(grid.select("_cell", prediction.alias("prediction"))), "_cell").drop("_cell")
