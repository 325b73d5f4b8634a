"""Exact quantiles by bracketing, and exact modes.

A sketch gives two values around each order statistic asked for. One scan counts what lies below the bracket and inside it, which also
proves where the statistic is; a second one brings back the few distinct values in between. A bracket that still holds many values is
narrowed by a sketch of its inside first, for which these values are held apart, and one that a sketch got wrong is widened, so the
result is exact. Nothing is sorted, shuffled by value or written.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank error of a sketch is 1 / ACCURACY of the rows; brackets with up to FEW values are brought to the driver.
ACCURACY, FEW = 2000, 10_000
#: Values inside brackets are held apart when they are at most this share of all.
SLIVER = 0.1


@dataclass
class _Bracket:
    """The order statistic ``rank`` (from 0) of a column lies between low and high, both excluded; None is open."""
    name: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    margin: float = 2.0
    exact: float | None = None

    def interval(self) -> tuple:
        """What sharing a sketch depends on, and last what sharing borders does."""
        open_low, open_high = self.low is None, self.high is None
        return self.name, open_low, 0.0 if open_low else self.low, open_high, 0.0 if open_high else self.high, self.margin

    def holds(self, x: Column) -> Column:
        at = x.isNotNull()
        at = at if self.low is None else at & (x > F.lit(self.low))
        return at if self.high is None else at & (x < F.lit(self.high))


def _narrow(df: DataFrame, columns: dict[str, Column], open_: list[_Bracket]) -> None:
    """A sketch of what is inside each bracket gives tighter borders; a counting scan tells where the order statistic is.

    Brackets of the same interval share one sketch, and those of neighbouring ranks their new borders too."""
    pools: list[list[_Bracket]] = []
    for b in sorted(open_, key=lambda b: (b.interval(), b.rank)):
        if pools and pools[-1][-1].interval() == b.interval() and b.rank - pools[-1][-1].rank <= 1:
            pools[-1].append(b)
        else:
            pools.append([b])

    def at(b: _Bracket, side: int) -> float:
        return min(max((b.rank - b.below) / b.inside + side * (1 / b.inside + b.margin / ACCURACY), 0.0), 1.0)

    sketches: dict[tuple, list[int]] = {}
    for i, pool in enumerate(pools):
        sketches.setdefault(pool[0].interval()[:-1], []).append(i)
    asked = [[s for i in members for s in (at(pools[i][0], -1), at(pools[i][-1], 1))] for members in sketches.values()]
    first = [pools[members[0]][0] for members in sketches.values()]
    row = df.agg(*[F.percentile_approx(F.when(b.holds(columns[b.name]), columns[b.name]), shares, ACCURACY).alias(f"q{j}")
                   for j, (b, shares) in enumerate(zip(first, asked))]).first()
    borders = {i: row[f"q{j}"][2 * k:2 * k + 2] for j, members in enumerate(sketches.values()) for k, i in enumerate(members)}

    def counts(i: int, b: _Bracket) -> list[Column]:
        x, (low, high) = columns[b.name], borders[i]
        return [F.count_if(b.holds(x) & (x < F.lit(low))).alias(f"u{i}"), F.count_if(x == F.lit(low)).alias(f"l{i}"),
                F.count_if((x > F.lit(low)) & (x < F.lit(high))).alias(f"i{i}")]

    counted = df.agg(*[c for i, pool in enumerate(pools) for c in counts(i, pool[0])]).first()
    for i, b in ((i, b) for i, pool in enumerate(pools) for b in pool):
        low, high = borders[i]
        under, at_low, inside = b.below + counted[f"u{i}"], counted[f"l{i}"], counted[f"i{i}"]
        if b.rank < under:  # beyond what the sketch promises
            b.margin *= 8
        elif b.rank < under + at_low:
            b.exact = low
        elif b.rank < under + at_low + inside:
            b.low, b.high, b.below, b.inside = low, high, under + at_low, inside
        elif low == high or b.margin > ACCURACY:
            b.low, b.below, b.inside = high, under + at_low + inside, b.below + b.inside - under - at_low - inside
        else:  # it is the upper border, or above it
            b.low, b.below, b.inside = _just_below(high), under + at_low + inside, b.below + b.inside - under - at_low - inside


def _just_below(x: float) -> float:
    return math.nextafter(x, -math.inf)


def _inside(df: DataFrame, columns: dict[str, Column], open_: list[_Bracket]) -> tuple[DataFrame, dict[str, Column]]:
    """(k, v) of the values inside the brackets, and them as columns by k, which the brackets are named from now on."""
    one, cells = _cells(df, columns, open_)
    for b, k in [(b, one[b.interval()[:-1]]) for b in open_]:
        b.name = str(k)
    return cells, {str(k): F.when(F.col("k") == k, F.col("v")) for k in one.values()}


def _cells(df: DataFrame, columns: dict[str, Column], open_: list[_Bracket]) -> tuple[dict[tuple, int], DataFrame]:
    """A number for each interval, and rows (k, v) of the values inside; only rows with such a value reach the arrays."""
    places: dict[tuple, int] = {}
    one = []
    for b in open_:
        if b.interval()[:-1] not in places:
            places[b.interval()[:-1]] = len(places)
            one.append(b)
    holds = [b.holds(columns[b.name]) for b in one]
    cells = F.array(*[F.when(h, F.struct(F.lit(k).alias("k"), columns[b.name].alias("v"))) for k, (b, h) in enumerate(zip(one, holds))])
    some = df.where(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in holds]))
    return places, some.select(F.explode(F.filter(cells, lambda c: c.isNotNull())).alias("c")).select("c.k", "c.v")


def _read_off(df: DataFrame, columns: dict[str, Column], few: list[_Bracket]) -> None:
    """The order statistics of brackets with few values, from the counted distinct values inside."""
    places, cells = _cells(df, columns, few)
    rows = cells.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).collect()
    for b in few:
        i, upto = places[b.interval()[:-1]], b.below
        for r in sorted((r for r in rows if r.k == i), key=lambda r: (r.v != r.v, r.v)):
            upto += r.n
            if b.rank < upto:
                b.exact = r.v
                break


def exact_quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float]) -> dict[str, list[float] | None]:
    """{name: [quantile of each share]} with linear interpolation; None for a column without values.

    ``columns`` are double expressions; nulls are left out.
    """
    names = list(columns)
    if not names:
        return {}
    x = {c: columns[c].cast("double") for c in names}
    counted = df.agg(*[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(names)]).first()
    totals = {c: counted[f"n{i}"] for i, c in enumerate(names)}
    brackets = {(c, r): _Bracket(c, r, totals[c]) for c in names if totals[c] for s in shares
                for r in (math.floor((totals[c] - 1) * s), math.ceil((totals[c] - 1) * s))}
    rows, read, held = df, x, None
    try:
        while waiting := [b for b in brackets.values() if b.exact is None]:
            few = [b for b in waiting if b.inside <= FEW]
            if few:
                _read_off(rows, read, few)
            if len(few) < len(waiting):
                _narrow(rows, read, [b for b in waiting if b.exact is None])
                waiting = [b for b in brackets.values() if b.exact is None]
                values = sum({b.interval()[:-1]: b.inside for b in waiting}.values())
                if waiting and held is None and values <= sum(totals.values()) * SLIVER:  # from here on only these values matter
                    held, read = _inside(df, x, waiting)
                    rows = held = held.persist()
    finally:
        if held is not None:
            held.unpersist()

    def quantile(c: str, share: float) -> float:
        at = (totals[c] - 1) * share
        low, high = math.floor(at), math.ceil(at)
        first, last = brackets[c, low].exact, brackets[c, high].exact
        return first if low == high else (high - at) * first + (at - low) * last

    return {c: [quantile(c, s) for s in shares] if totals[c] else None for c in names}


def exact_modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """{column: most frequent value, the smallest on ties}, as a top-1 over the value counts of each column."""
    out = {}
    for c in columns:
        top = (df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
               .orderBy(F.desc("n"), "v").limit(1).collect())
        out[c] = top[0].v if top else None
    return out
