"""DBSCAN on any number of numeric columns, exact, without all pairs.

Space is cut into cells of side eps / sqrt(d), so points of one cell are neighbours. A cell of ``min_samples`` points or
more has core points only, whatever their number: no pair inside a cell is ever looked at. Only the points of thinner cells
count their neighbours, against the cells around them. Whether two cells of core points touch is decided on bounding boxes:
boxes that are within eps as a whole, or nowhere, need no points; those between are cut in halves, round after round, and points are
compared only where the two boxes have few. So a cell that holds a third of all rows costs one box a round. Rows with equal values are one point with a weight.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import as_double
from ..session import ensure_checkpoint_dir
from .graph import connected_components

FEW = 4096  # pairs of points that two boxes may have to be compared point by point


def _apart(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _distance(a: str, b: str, d: int) -> Column:
    """Squared distance."""
    return _apart((F.get(a, F.lit(i)) - F.get(b, F.lit(i))) * (F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(d))


def _boxes(core: DataFrame, d: int, side: float, level: int) -> DataFrame:
    """Rows (cell, box, lo, hi, n): bounding boxes of the core points of each cell, cut ``level`` times in halves."""
    place = F.array(*[F.floor(F.get("x", F.lit(i)) * (2 ** level / side)) for i in range(d)])
    return core.select("cell", place.alias("box"), "x").groupBy("cell", "box").agg(
        F.array(*[F.min(F.get("x", F.lit(i))) for i in range(d)]).alias("lo"),
        F.array(*[F.max(F.get("x", F.lit(i))) for i in range(d)]).alias("hi"), F.count(F.lit(1)).alias("n"))


def _links(core: DataFrame, near: DataFrame, d: int, side: float, eps: float) -> DataFrame:
    """Pairs of cells (a, b) of ``near`` with core points within eps of each other."""
    def gap(i):
        return F.greatest(F.get("lo_a", F.lit(i)) - F.get("hi_b", F.lit(i)), F.get("lo_b", F.lit(i)) - F.get("hi_a", F.lit(i)), F.lit(0.0))
    def reach(i):  # noqa: E306
        return F.greatest(F.get("hi_a", F.lit(i)) - F.get("lo_b", F.lit(i)), F.get("hi_b", F.lit(i)) - F.get("lo_a", F.lit(i)))
    least, most = _apart(gap(i) * gap(i) for i in range(d)), _apart(reach(i) * reach(i) for i in range(d))
    side_of = lambda boxes, s: boxes.select(*[F.col(c).alias(s if c == "cell" else f"{c}_{s}") for c in boxes.columns])
    points = lambda level, s: core.select(
        F.col("cell").alias(s), F.array(*[F.floor(F.get("x", F.lit(i)) * (2 ** level / side)) for i in range(d)]).alias(f"box_{s}"), F.col("x").alias(f"x_{s}"))
    boxes = _boxes(core, d, side, 0)
    open_ = near.join(side_of(boxes, "a"), "a").join(side_of(boxes, "b"), "b")
    found, level = None, 0
    while True:
        judged = open_.withColumn("least", least).withColumn("most", most).where(F.col("least") <= eps * eps).checkpoint()
        sure = judged.where(F.col("most") <= eps * eps).select("a", "b").distinct()
        rest = judged.join(sure, ["a", "b"], "left_anti").select("a", "b", "box_a", "box_b", (F.col("n_a") * F.col("n_b")).alias("work")).checkpoint()
        close = (rest.where(F.col("work") <= FEW).join(points(level, "a"), ["a", "box_a"]).join(points(level, "b"), ["b", "box_b"])
                 .where(_distance("x_a", "x_b", d) <= eps * eps).select("a", "b").distinct())
        new = sure.unionByName(close).distinct().checkpoint()
        found = new if found is None else found.unionByName(new)
        rest = rest.where(F.col("work") > FEW).join(new, ["a", "b"], "left_anti")
        level += 1
        boxes = _boxes(core, d, side, level)
        half = lambda s: F.transform(f"box_{s}", lambda v: F.floor(v / 2))
        sides = [side_of(boxes, s).withColumn("up", half(s)) for s in "ab"]
        open_ = (rest.withColumnsRenamed({"box_a": "up_a", "box_b": "up_b"}).drop("work")
                 .join(sides[0].withColumnRenamed("up", "up_a"), ["a", "up_a"]).join(sides[1].withColumnRenamed("up", "up_b"), ["b", "up_b"])
                 .drop("up_a", "up_b").checkpoint())
        if open_.isEmpty():
            return found


def dbscan(df: DataFrame, id_col: str, columns: list[str], eps: float = 0.5, min_samples: int = 5, standardize: bool = True) -> DataFrame:
    """(id, is_core, is_noise, cluster) of rows without nulls in ``columns``, standardised (ddof 0) by default.

    A cluster is named by the smallest id of its core points; a border point joins the cluster of smallest name within reach.
    """
    ensure_checkpoint_dir(df.sparkSession)
    d = len(columns)
    full = df.select(F.col(id_col).alias("id"), *[as_double(c).alias(f"v{i}") for i, c in enumerate(columns)]).na.drop(
        subset=[f"v{i}" for i in range(d)])
    values = [F.col(f"v{i}") for i in range(d)]
    if standardize:
        s = full.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values)]).first()
        values = [(v - F.lit(s[f"m{i}"])) / F.lit(s[f"s{i}"] or 1.0) for i, v in enumerate(values)]
    side = eps / d ** 0.5 * (1 - 1e-9)
    rows = full.select("id", F.array(*[v + F.lit(0.0) for v in values]).alias("x")).checkpoint()
    places = F.array(*[F.floor(F.get("x", F.lit(i)) / side) for i in range(d)])
    points = rows.groupBy("x").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("at", places)
    cells = points.groupBy("at").agg(F.min("rep").alias("cell"), F.sum("n").alias("size")).checkpoint()
    points = points.join(cells, "at").select("rep", "x", "n", "cell", "size").checkpoint()

    # cells within reach of each other, found by blocks of cells in the first two dimensions
    wide, g = int(d ** 0.5) + 1, min(d, 2)
    block = [F.floor(F.get("at", F.lit(i)) / wide) for i in range(g)]
    spread = cells.select("cell", "at", F.explode(F.array(*[F.struct(*[(b + o).alias(f"k{i}") for i, (b, o) in enumerate(zip(block, step))])
                                                            for step in product((-1, 0, 1), repeat=g)])).alias("k")).select(
        F.col("cell").alias("a"), F.col("at").alias("at_a"), "k.*")
    fixed = cells.select(F.col("cell").alias("b"), F.col("at").alias("at_b"), *[b.alias(f"k{i}") for i, b in enumerate(block)])
    step = lambda i: F.greatest(F.abs(F.get("at_a", F.lit(i)) - F.get("at_b", F.lit(i))) - 1, F.lit(0))
    near = (spread.join(fixed, [f"k{i}" for i in range(g)]).where("a <> b").where(_apart(step(i) * step(i) for i in range(d)) <= d)
            .select("a", "b").checkpoint())

    thin = points.where(F.col("size") < min_samples)
    beside = (thin.select(F.col("rep").alias("p"), F.col("cell").alias("a"), F.col("x").alias("x_a")).join(near, "a")
              .join(points.select(F.col("cell").alias("b"), F.col("x").alias("x_b"), F.col("n").alias("n_b"), F.col("rep").alias("q")), "b")
              .where(_distance("x_a", "x_b", d) <= eps * eps))
    more = beside.groupBy("p").agg(F.sum("n_b").alias("more"))
    flagged = points.join(more.withColumnRenamed("p", "rep"), "rep", "left").withColumn(
        "is_core", F.col("size") + F.coalesce("more", F.lit(0)) >= min_samples).select("rep", "x", "cell", "size", "is_core").checkpoint()
    core = flagged.where("is_core").select("rep", "x", "cell")
    with_core = core.select("cell").distinct()
    touching = near.where("a < b").join(with_core.withColumnRenamed("cell", "a"), "a", "left_semi").join(
        with_core.withColumnRenamed("cell", "b"), "b", "left_semi")
    links = _links(core, touching, d, side, eps)
    joined = connected_components(with_core.withColumnRenamed("cell", "id"), links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = core.join(joined.withColumnRenamed("id", "cell"), "cell").select("rep", "cell", "component")
    names = placed.groupBy("component").agg(F.min("rep").alias("cluster"))
    placed = placed.join(names, "component").select("rep", "cell", "cluster").checkpoint()

    border = flagged.where("NOT is_core")
    own = border.select("rep", "cell").join(placed.select("cell", "cluster"), "cell").select("rep", "cluster")
    other = (beside.select("p", "q").join(border.select(F.col("rep").alias("p")), "p")
             .join(placed.select(F.col("rep").alias("q"), "cluster"), "q").select(F.col("p").alias("rep"), "cluster"))
    reached = own.unionByName(other).groupBy("rep").agg(F.min("cluster").alias("cluster"))
    clusters = placed.select("rep", "cluster").unionByName(reached)
    named = flagged.join(clusters, "rep", "left").select("x", "is_core", F.col("cluster").isNull().alias("is_noise"), "cluster")
    return rows.join(named, "x").select(F.col("id").alias(id_col), "is_core", "is_noise", "cluster")
