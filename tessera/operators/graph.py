"""Graphs derived from tables: association measures, entity graphs, degree, components,
PageRank, modularity and k-hop neighbourhoods, as DataFrame programs.

A graph is two DataFrames: ``nodes(id)`` and ``edges(src, dst, weight)`` (undirected
unless stated). Iterative algorithms are loops of joins + aggregates; every few
rounds the state is ``checkpoint()``-ed to the cluster's checkpoint folder so
lineage stays short and a lost executor recomputes at most a few rounds.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..functions.stats import as_double, numeric_columns, rnd, safe_corr, string_columns


# ---------------------------------------------------------------- association measures
def corr_edges(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Numeric column pairs with |r| >= threshold."""
    from .quality import corr_pairs
    return (corr_pairs(df).where(F.abs("correlation") >= threshold)
            .select(F.col("col_a").alias("src"), F.col("col_b").alias("dst"), rnd("correlation", 4).alias("weight")))


def cramers_v(df: DataFrame, a: str, b: str, min_rows: int = 10) -> DataFrame:
    """Cramer's V from the contingency table (no continuity correction)."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cell = x.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    ra = cell.groupBy(a).agg(F.sum("o").alias("r"))
    cb = cell.groupBy(b).agg(F.sum("o").alias("c"))
    j = cell.join(ra, a).join(cb, b)
    s = j.agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("q"), F.sum("o").alias("n"))
    k = x.agg(F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    from .quality import merge_one_row
    m = merge_one_row([s, k])
    chi2 = F.col("n") * (F.col("q") - 1)
    kmin = F.least(F.col("ka"), F.col("kb")) - 1
    v = F.when((F.col("n") >= min_rows) & (kmin > 0), F.sqrt(F.greatest(chi2, F.lit(0.0)) / (F.col("n") * kmin)))
    return m.select(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), rnd(chi2, 4).alias("chi2"), rnd(v, 4).alias("cramers_v"))


def eta_squared(df: DataFrame, cat: str, num: str, min_rows: int = 10) -> DataFrame:
    """Correlation ratio SSB / SST (textbook form), capped at 1; NULL below 10 rows or 2 groups."""
    x = df.where(F.col(cat).isNotNull() & as_double(num).isNotNull()).select(cat, as_double(num).alias("y"))
    g = x.groupBy(cat).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"))
    tot = x.agg(F.count(F.lit(1)).alias("N"), F.avg("y").alias("M"), (F.var_pop("y") * F.count(F.lit(1))).alias("sst")).first()
    if tot["N"] == 0:
        return df.sparkSession.createDataFrame([(cat, num, None)], "categorical string, numeric string, eta_squared double")
    ssb = g.agg(F.sum(F.col("n") * (F.col("m") - F.lit(tot["M"])) ** 2).alias("ssb"), F.count(F.lit(1)).alias("k"))
    e = F.least(F.try_divide(F.col("ssb"), F.lit(tot["sst"])), F.lit(1.0))
    ok = (F.lit(tot["N"]) >= min_rows) & (F.col("k") >= 2)
    return ssb.select(F.lit(cat).alias("categorical"), F.lit(num).alias("numeric"), rnd(F.when(ok, e), 4).alias("eta_squared"))


# ---------------------------------------------------------------- entity graph
def key_columns(df: DataFrame, max_distinct: int = 50) -> list[str]:
    """Advice on which text columns suit an entity graph: those with at most ``max_distinct`` values.
    The graph itself takes its columns from the caller."""
    from .profile import distinct_counts
    cols = string_columns(df)
    nd = {r.column_name: r.n_distinct for r in distinct_counts(df, cols).collect()}
    return [c for c in cols if nd.get(c, 0) <= max_distinct]


def entity_nodes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One node per (column, value) with its frequency."""
    from .profile import value_counts_long
    return value_counts_long(df, columns).select(
        F.concat_ws("=", "column_name", "value").alias("id"), "column_name", "value", F.col("n").alias("frequency"))


def entity_edges(df: DataFrame, columns: list[str], min_count: int = 2) -> DataFrame:
    """Co-occurrence of values of two key columns in one row, weight = rows, kept if >= min_count.

    One grouped count per column pair (no self-join of rows).
    """
    def name(c):  # as in the nodes, which compare floats as doubles
        kind = df.schema[c].dataType.simpleString()
        return F.concat_ws("=", F.lit(c), (F.col(c).cast("double") if kind == "float" else F.col(c)).cast("string"))

    parts = []
    for a, b in combinations(columns, 2):
        parts.append(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(
            name(a).alias("src"), name(b).alias("dst")).agg(F.count(F.lit(1)).alias("weight")))
    return reduce(DataFrame.unionByName, parts).where(F.col("weight") >= min_count)


# ---------------------------------------------------------------- structure
def both_directions(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree, weighted degree, degree centrality = degree / (n - 1)."""
    n = nodes.count()
    d = both_directions(edges).groupBy(F.col("src").alias("id")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree"))
    out = nodes.select("id").join(d, "id", "left").fillna(0, ["degree", "weighted_degree"])
    return out.select("id", "degree", rnd(F.col("weighted_degree").cast("double"), 4).alias("weighted_degree"),
                      rnd(F.col("degree") / F.lit(float(max(n - 1, 1))), 4).alias("degree_centrality"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, density 2m / (n (n - 1)), average degree 2m / n."""
    n = nodes.count()
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    return m.select(F.lit(n).cast("long").alias("n_nodes"), F.col("m").alias("n_edges"),
                    rnd(F.try_divide(2.0 * F.col("m"), F.lit(float(n * (n - 1)))), 6).alias("density"),
                    rnd(F.try_divide(2.0 * F.col("m"), F.lit(float(n))), 4).alias("avg_degree"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component = smallest id in it), by alternating large-star and small-star contraction.

    Only the edge list is rewritten, the input is read once; every round shortens paths by a constant
    factor, so a path of n nodes takes about log n rounds. It runs until the edges stay the same.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    e = (edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
         .distinct().checkpoint())
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.max("v")).first()
        if state == before:
            break
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    return nodes.join(e.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 20,
             tol: float | None = None, directed: bool = False) -> DataFrame:
    """Weighted PageRank; dangling mass spread uniformly; fixed rounds or until L1 change < n * tol.

    The transition table is checkpointed once and the ranks after each few rounds; a round is one join
    and one aggregation on it.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    e = edges if directed else both_directions(edges)
    out_w = e.groupBy("src").agg(F.sum("weight").alias("ow"))
    trans = e.join(out_w, "src").select("src", "dst", (F.col("weight") / F.col("ow")).alias("p")).checkpoint()
    ranks = nodes.select("id").checkpoint()
    n = ranks.count()
    base = ranks
    ranks = ranks.withColumn("rank", F.lit(1.0 / max(n, 1)))
    has_out = trans.select(F.col("src").alias("id")).distinct()
    for r in range(1, rounds + 1):
        # an undirected graph has no dangling nodes: every node listed has an edge; directed
        # graphs need the mass of rank-holding nodes without out-edges (one number per round)
        dangling = 0.0 if not directed else (
            ranks.join(has_out, "id", "left_anti").agg(F.sum("rank")).first()[0] or 0.0)
        contrib = trans.join(ranks, trans["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("s"))
        new = base.join(contrib, base["id"] == contrib["dst"], "left").select(
            "id", (F.lit((1 - alpha) / n) + F.lit(alpha) * (F.coalesce("s", F.lit(0.0)) + F.lit(dangling / n))).alias("rank"))
        if r % 4 == 0 or directed or tol is not None:
            new = new.checkpoint()
        if tol is not None:
            diff = new.join(ranks.withColumnRenamed("rank", "old"), "id").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            ranks = new
            if diff < n * tol:
                break
        else:
            ranks = new
    return ranks


def modularity(edges: DataFrame, partition: DataFrame, community: str = "component") -> DataFrame:
    """Q = sum_c (L_c / m - (d_c / 2m)^2) with weights; ``partition`` is (id, community)."""
    e = edges.select("src", "dst", as_double("weight").alias("w"))
    m = e.agg(F.sum("w")).first()[0] or 0.0
    p = partition.select("id", F.col(community).alias("c"))
    intra = (e.join(p.withColumnRenamed("id", "src").withColumnRenamed("c", "cs"), "src")
             .join(p.withColumnRenamed("id", "dst").withColumnRenamed("c", "cd"), "dst")
             .where(F.col("cs") == F.col("cd")).groupBy(F.col("cs").alias("c")).agg(F.sum("w").alias("L")))
    deg = both_directions(edges).groupBy(F.col("src").alias("id")).agg(F.sum(as_double("weight")).alias("d"))
    dc = deg.join(p, "id").groupBy("c").agg(F.sum("d").alias("D"))
    q = dc.join(intra, "c", "left").agg(
        F.sum(F.coalesce("L", F.lit(0.0)) / F.lit(m) - (F.col("D") / F.lit(2 * m)) ** 2).alias("modularity"),
        F.count(F.lit(1)).alias("n_communities"))
    return q.select(rnd("modularity", 4).alias("modularity"), "n_communities")


def _moved(every: DataFrame, labels: DataFrame, m: float, rounds: int) -> DataFrame:
    """``labels`` (id, c, k) after rounds in which single nodes change their community to raise modularity.

    Half of the nodes (by hash) make their best move, if the exact modularity of the result is at least that after the sure moves: the
    best ones of both communities that they touch, whose gains add up as they share none.
    """
    arcs = every.where("u <> v").select("u", "v", "w")
    arcs = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))

    def quality(named):
        inner = (every.join(named.select(F.col("id").alias("u"), F.col("c").alias("a")), "u")
                 .join(named.select(F.col("id").alias("v"), F.col("c").alias("b")), "v").where("a = b").agg(F.sum("w")).first()[0] or 0.0)
        spread = named.groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0.0
        return inner / m - spread / (4 * m * m)

    now = quality(labels)
    for i in range(rounds):
        total = labels.groupBy("c").agg(F.sum("k").alias("kc"))
        own = labels.join(total.withColumnRenamed("kc", "ko"), "c").select(F.col("id").alias("u"), F.col("c").alias("co"), "k", "ko")
        links = (arcs.join(labels.select(F.col("id").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
                 .join(own, "u").join(total, "c"))
        stay = links.where("c = co").select("u", F.col("w").alias("wo"))
        gain = (F.col("w") - F.coalesce("wo", F.lit(0.0))) / m - F.col("k") * (F.col("kc") - F.col("ko") + F.col("k")) / (2 * m * m)
        moves = (links.where("c <> co").join(stay, "u", "left").withColumn("g", gain).where("g > 1e-12")
                 .groupBy("u", "co").agg(F.min(F.struct((-F.col("g")).alias("g"), "c")).alias("b"))
                 .select("u", "co", "b.c", F.struct("b.g", "u").alias("key")).checkpoint())
        firsts = moves.select(F.explode(F.array("co", "c")).alias("x"), "key").groupBy("x").agg(F.min("key").alias("key"))
        sure = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("key.u", (-F.col("key.g")).alias("g")).checkpoint()
        gained = sure.agg(F.sum("g")).first()[0]
        if gained is None:
            break
        for chosen in (moves.where(F.pmod(F.xxhash64("u", F.lit(i)), F.lit(2)) == 0), moves.join(sure.select("u"), "u", "left_semi")):
            new = labels.join(chosen.select(F.col("u").alias("id"), F.col("c").alias("to")), "id", "left").select(
                "id", F.coalesce("to", "c").alias("c"), "k").checkpoint()
            then = quality(new)
            if then >= now + gained * (1 - 1e-9):
                break
        labels, now = new, then
    return labels


def communities(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100, refine: int = 4) -> DataFrame:
    """(id, community = smallest id in it) by greedy modularity in rounds on a graph that shrinks with each.

    Merging communities u and v raises modularity by w/m - k_u k_v / 2m^2. In a round every community picks its best
    partner (ties: smallest ids); those that pick each other merge. As the pairs are disjoint their gains add up exactly.
    The others may then move to the pair that gains most; that is kept only if the whole round gains at least as much as the
    pairs alone. So modularity rises in every round, the best edge of all is always a pair, and it ends when no edge gains.
    A round is three joins and four aggregations on the contracted edges; loops and repeated edges are summed up. Whole-numbered
    weights have exact sums, so reruns agree. In up to ``refine`` more rounds single nodes change sides where that gains (``_moved``).
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    w = as_double("weight")
    every = edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum(w).alias("w")).checkpoint()
    m = every.agg(F.sum("w")).first()[0] or 0.0
    labels = nodes.select("id", F.col("id").alias("c"))
    if m <= 0:
        return labels.withColumnRenamed("c", "community")
    ends = every.select(F.col("u").alias("c"), "w").unionByName(every.select(F.col("v").alias("c"), "w"))
    k = ends.groupBy("c").agg(F.sum("w").alias("k")).checkpoint()
    e = every.where("u <> v")
    gain = lambda w, a, b: F.col(w) / m - F.col(a) * F.col(b) / (2 * m * m)
    for _ in range(max_rounds):
        sides = (e.join(k.select(F.col("c").alias("u"), F.col("k").alias("ku")), "u")
                 .join(k.select(F.col("c").alias("v"), F.col("k").alias("kv")), "v").withColumn("g", gain("w", "ku", "kv")).checkpoint())
        both = sides.where("g > 0").select("u", "v", "g").withColumn("edge", F.struct((-F.col("g")).alias("g"), "u", "v"))
        best = both.select(F.explode(F.array("u", "v")).alias("c"), "edge").groupBy("c").agg(F.min("edge").alias("edge"))
        pairs = (best.groupBy("edge").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
                 .select("edge.u", "edge.v", (-F.col("edge.g")).alias("g")).checkpoint())
        sure = pairs.agg(F.sum("g")).first()[0]
        if sure is None:
            break
        paired = pairs.select(F.explode(F.array("u", "v")).alias("c"), F.col("u").alias("to"))
        joint = paired.join(k, "c").groupBy("to").agg(F.sum("k").alias("kp"))
        arcs = sides.select("u", "v", "w", "ku").unionByName(sides.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", F.col("kv").alias("ku")))
        moves = (arcs.join(paired, arcs["v"] == paired["c"]).groupBy("u", "ku", "to").agg(F.sum("w").alias("w"))
                 .join(paired.select(F.col("c").alias("u")), "u", "left_anti").join(joint, "to").withColumn("g", gain("w", "ku", "kp")).where("g > 0")
                 .groupBy("u").agg(F.min(F.struct((-F.col("g")).alias("g"), "to")).alias("b")).select(F.col("u").alias("c"), "b.to"))
        for goes in (paired.unionByName(moves).checkpoint(), paired):
            named = k.join(goes, "c", "left").select("c", "k", F.coalesce("to", "c").alias("to")).checkpoint()
            to = named.select("c", "to")
            merged = (e.join(to.withColumnsRenamed({"c": "u", "to": "a"}), "u").join(to.withColumnsRenamed({"c": "v", "to": "b"}), "v")
                      .groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("w")).checkpoint())
            new_k = named.groupBy(F.col("to").alias("c")).agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("q"))
            inner = merged.where("u = v").agg(F.sum("w")).first()[0] or 0.0
            spread = new_k.agg(F.sum(F.col("k") * F.col("k") - F.col("q"))).first()[0]
            if inner / m - spread / (4 * m * m) >= sure * (1 - 1e-12):
                break
        labels = labels.join(to, "c", "left").select("id", F.coalesce("to", "c").alias("c")).checkpoint()
        e, k = merged.where("u <> v"), new_k.select("c", "k").checkpoint()
    strength = ends.withColumnRenamed("c", "id").groupBy("id").agg(F.sum("w").alias("k"))
    labels = _moved(every, labels.join(strength, "id", "left").select("id", "c", F.coalesce("k", F.lit(0.0)).alias("k")).checkpoint(), m, refine)
    least = labels.groupBy("c").agg(F.min("id").alias("community"))
    return labels.join(least, "c").select("id", "community")


def neighbors(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``hops`` of the seed ids, with hop distance, and the induced edges (two semi-joins)."""
    adj = both_directions(edges).select("src", "dst")
    reached = seeds.select("id", F.lit(0).alias("hop"))
    frontier = reached
    for h in range(1, hops + 1):
        nxt = (adj.join(frontier, adj["src"] == frontier["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
               .join(reached, "id", "left_anti").select("id", F.lit(h).alias("hop")))
        reached = reached.unionByName(nxt)
        frontier = nxt
    ids = reached.select("id")
    sub = (edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
           .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    return reached, sub


def clustering(edges: DataFrame) -> DataFrame:
    """Weighted clustering coefficient of each node: the sum over its triangles of the cube root of the
    three weights (each divided by the largest weight), over its number of neighbour pairs.

    Each triangle is found once: edges point from the node of lower (degree, id) to the higher one, so a hub
    has few outgoing edges, and two outgoing edges of a node are closed by a third.
    """
    e = (edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), as_double("weight").alias("w"))
         .groupBy("a", "b").agg(F.sum("w").alias("w")))
    most = e.agg(F.max("w")).first()[0] or 1.0
    deg = e.select("a").union(e.select("b")).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    both = (e.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a")
            .join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b"))
    up = F.struct("da", "a") < F.struct("db", "b")
    arcs = both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"),
                       F.when(up, F.col("db")).otherwise(F.col("da")).alias("dv"), (F.col("w") / F.lit(most)).alias("w"))
    one, two = arcs.select("u", F.col("v").alias("x"), F.col("dv").alias("dx"), F.col("w").alias("w1")), \
        arcs.select("u", F.col("v").alias("y"), F.col("dv").alias("dy"), F.col("w").alias("w2"))
    wedges = one.join(two, "u").where(F.struct("dx", "x") < F.struct("dy", "y"))
    closed = wedges.join(arcs.select(F.col("u").alias("x"), F.col("v").alias("y"), F.col("w").alias("w3")), ["x", "y"])
    per = closed.select(F.explode(F.array("u", "x", "y")).alias("id"), F.pow(F.col("w1") * F.col("w2") * F.col("w3"), F.lit(1.0 / 3)).alias("t"))
    total = per.groupBy("id").agg(F.sum("t").alias("t"))
    return deg.join(total, "id", "left").select("id", rnd(F.when(F.col("d") > 1, F.coalesce("t", F.lit(0.0)) * 2 / (F.col("d") * (F.col("d") - 1)))
                                                          .otherwise(F.lit(0.0)), 4).alias("clustering"))
