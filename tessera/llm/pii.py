"""Personal data: fixed patterns as seeds, then bootstrapped contextual extraction.

1. One pass over the texts finds e-mail addresses, IP addresses, card and phone numbers
   (the base) and all other tokens with a digit (candidates), each with its place and the
   two whole words before the word in which it starts.
2. Those two words are a lexical pattern, the value is an instance; pattern and instance
   are the sides of a graph whose edges are occurrences. A pattern's confidence is the
   share of all its occurrences in all texts, before whatever word, that are followed by a
   known value, less a margin for few observations; a pattern needs ``support`` distinct
   known values. An instance's confidence is 1 - prod(1 - c) over its patterns.
3. ``rounds`` times, patterns are scored by the instances known so far (the seeds at
   first), and instances above ``accept`` become known. Occurrences of the accepted
   instances after confident patterns are reported as kind ``learned``.

Everything is regular expressions, array functions, joins and grouped sums. Hub patterns and
repeated values are summed up before each shuffle; the occurrences of word pairs in the
corpus are first filtered by a table of hash slots, some 16 for each pattern that is to be
counted and 64 KB at most (it is part of the plan text, which the driver keeps), then joined.

The expressions are those of the contract, written so that they can't be quadratic or
recursive on very long runs: starts are tied to the start of a run (or the end of
the match before), repeats are possessive. They match the same strings.

Defined cases: a null text is empty; places are code points, end exclusive; repeated rows
each get their spans; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textfn import let, words

KINDS = ["email", "ip", "card", "phone"]
LEARNED = "learned"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]*[0-9])[^\x20\x09-\x0D]++",
}
SLOTS, PARTS = 1 << 16, 32  # at most; a power of two
MARK, UNMARK = "\x01", "\x02"  # neither is white space, nor in a class of the base patterns


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(total, i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def holds(kind: Column, value: Column) -> Column:
    """The checks that a match of each kind must pass."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    octets = F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
        F.split(value, r"\."), lambda p: F.coalesce(F.right(F.concat(F.lit("000"), F.regexp_replace(p, "^0+", "")), F.lit(3)).cast("int"), F.lit(0)) <= 255)
    return (F.when(kind == "ip", octets).when(kind == "card", luhn(digits))
            .when(kind == "phone", F.length(digits).between(9, 15)).otherwise(F.lit(True)))


def found(text: Column, kind: str) -> Column:
    """Matches of a kind in order: value, code points since the match before, and the word (counted from 0) in which each starts."""
    expression = F.lit(PATTERNS[kind])
    def build(matches):  # noqa: E306
        return F.when(F.size(matches) > 0, let(F.slice(F.split(text, PATTERNS[kind]), 1, F.size(matches)), lambda gaps: F.zip_with(
            matches, F.zip_with(gaps, starts(gaps, matches), lambda g, w: F.struct(F.length(g).alias("gap"), w.alias("word"))),
            lambda m, x: F.struct(m.alias("value"), x["gap"].alias("gap"), x["word"].alias("word")))))
    return let(F.regexp_extract_all(text, expression, F.lit(0)), build)


def starts(gaps: Column, matches: Column) -> Column:
    """The word in which each match starts: marks are set at the starts, and counted in each word."""
    plain = lambda c: F.translate(c, MARK, UNMARK)
    marked = F.array_join(F.zip_with(gaps, matches, lambda g, m: F.concat(plain(g), F.lit(MARK), plain(m))), "")
    return F.flatten(F.transform(words(marked), lambda w, i: F.array_repeat(
        i, F.length(w) - F.length(F.translate(w, MARK, "")))))


def before(listed: Column, word: Column) -> Column:
    """Hash of the two words before the one at ``word``."""
    return F.when(word >= 2, F.xxhash64(F.get(listed, word - 2), F.get(listed, word - 1)))


def occurrences(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): one slim row per input row, and one row per match of any kind with its place."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    could = {"email": text.contains("@"), "phone": text.contains("+")}
    kinds = [F.col(f"f_{k}") for k in PATTERNS]
    hits = df.select(F.col(id_col).alias("id"), words(F.lower(text)).alias("words"), *[
        (F.when(could[k], found(text, k)) if k in could else found(text, k)).alias(f"f_{k}") for k in PATTERNS])
    listed = [F.transform(c, lambda x: F.struct(
        x["value"].alias("value"), x["gap"].alias("gap"), x["word"].alias("word"), before(F.col("words"), x["word"]).alias("pattern")))
        .alias(f"f_{k}") for k, c in zip(PATTERNS, kinds)]
    hits = scratch.keep(hits.select("id", *listed).withColumn("row", F.monotonically_increasing_id()), "hits")
    def rows_of(kind):  # noqa: E306
        return F.coalesce(F.transform(F.col(f"f_{kind}"), lambda x, j: F.struct(
            F.lit(kind).alias("kind"), x["value"].alias("value"), x["gap"].alias("gap"), x["word"].alias("word"),
            x["pattern"].alias("pattern"), j.alias("j"))), F.array())
    spans = hits.select("row", F.explode(F.concat(*[rows_of(k) for k in PATTERNS])).alias("s")).select("row", "s.*")
    run = Window.partitionBy("row", "kind").orderBy("j")
    end = F.sum(F.col("gap") + F.length("value")).over(run)
    spans = (spans.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
             .select("row", "kind", "start", "end", F.lower("value").alias("value"), "word", "pattern")
             .where((F.col("kind") == "token") | holds(F.col("kind"), F.col("value"))))
    return hits.select("row", "id"), scratch.keep(spans, "spans")


def _occurring(df: DataFrame, text_col: str, patterns: DataFrame) -> DataFrame:
    """Rows (pattern, total): how often the two words of each pattern stand before any word, in all texts of ``df``."""
    slots = min(SLOTS, 1 << max(10, (16 * patterns.count()).bit_length()))
    table = bytearray(slots)
    for (slot,) in patterns.select(F.pmod("pattern", F.lit(slots)).cast("int")).distinct().collect():  # at most SLOTS rows
        table[slot] = 1
    listed = lambda h: F.substr(F.lit(table), F.pmod(h, F.lit(slots)).cast("int") + 1, F.lit(1)) == F.lit(bytearray([1]))
    pairs = let(words(F.lower(F.coalesce(F.col(text_col), F.lit("")))), lambda w: F.when(F.size(w) > 2, F.filter(
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))), listed)))
    return df.select(F.explode(pairs).alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("total")).join(
        patterns.select("pattern"), "pattern", "left_semi")


def pattern_totals(df: DataFrame, text_col: str, patterns: DataFrame, confident: float, scratch: Scratch, name: str) -> DataFrame:
    """Rows (pattern, total) of the patterns that can become confident; ``patterns`` is (pattern, held), with all
    occurrences in the graph.

    Most patterns are pairs of common words. Even if all its values were known, such a pattern would stand before far more
    other words; occurrences in a part of the texts prove that, so it is not counted in the rest.
    """
    part = df.where(F.pmod(F.xxhash64(F.lit(17), text_col), F.lit(PARTS)) == 0)
    seen = _occurring(part, text_col, patterns)
    able = patterns.join(seen, "pattern", "left").where(
        (F.col("held") - 1) / (F.coalesce("total", F.lit(0)) + 1) >= confident).select("pattern")
    able = scratch.keep(able, f"able{name}")
    return scratch.keep(_occurring(df, text_col, able).join(able, "pattern"), f"totals{name}")


def bootstrap(df: DataFrame, text_col: str, spans: DataFrame, scratch: Scratch, rounds: int, support: int,
              confident: float, accept: float) -> DataFrame:
    """Occurrences (row, start, end) of learned identifiers."""
    base = spans.where("kind <> 'token'")
    apart = (spans.where("kind = 'token'").alias("t").join(
        base.select("row", F.col("start").alias("s"), F.col("end").alias("e")).alias("b"),
        (F.col("t.row") == F.col("b.row")) & (F.col("t.start") < F.col("e")) & (F.col("s") < F.col("t.end")), "left_anti"))
    # seeds that start in one word share its occurrence of the pattern: the first one counts it
    first = F.row_number().over(Window.partitionBy("row", "word").orderBy("start", "kind")) == 1
    edges = (apart.withColumn("n", F.lit(1)).unionByName(base.where("pattern is not null").withColumn("n", first.cast("int")))
             .where("pattern is not null").withColumn("seed", F.col("kind") != "token"))
    graph = edges.groupBy("pattern", "value").agg(F.sum("n").alias("n"), F.max("seed").alias("seed"))
    wide = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("held")).where(
        F.col("values") >= support).select("pattern", "held")
    wide = scratch.keep(wide, "patterns")
    graph = scratch.keep(graph.join(wide.select("pattern"), "pattern"), "graph0")
    reached, totals = None, None
    for i in range(1, rounds + 1):
        before, reached = reached, scratch.keep(
            graph.where("seed").groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("known"))
            .where(F.col("values") >= support), f"reached{i}")
        # known values only grow in number: a pattern is counted in the first round in which it has enough of them
        fresh = reached.join(wide, "pattern").select("pattern", "held")
        if before is not None:
            fresh = fresh.join(before, "pattern", "left_anti")
        fresh = scratch.keep(fresh, f"fresh{i}")
        if totals is None or not fresh.isEmpty():
            counted = pattern_totals(df, text_col, fresh, confident, scratch, str(i))
            totals = counted if totals is None else totals.unionByName(counted)
        score = (reached.join(totals, "pattern")
                 .select("pattern", ((F.col("known") - 1) / (F.col("total") + 1)).alias("conf")).where(F.col("conf") >= confident))
        score = scratch.keep(score, f"score{i}")
        learned = (graph.join(score, "pattern").groupBy("value")
                   .agg((1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.999)))))).alias("belief"))
                   .where(F.col("belief") >= accept).select("value", F.lit(True).alias("new")))
        graph = scratch.keep(graph.join(learned, "value", "left").withColumn(
            "seed", F.col("seed") | F.coalesce("new", F.lit(False))).drop("new"), f"graph{i}")
        scratch.drop(f"graph{i - 1}")
    known = graph.where("seed").select("pattern", "value").join(score.select("pattern"), "pattern")
    return edges.where("not seed").join(known, ["pattern", "value"], "left_semi").select("row", "start", "end")


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 4,
                  confident: float = 0.5, accept: float = 0.5) -> DataFrame:
    """One row per input row: ``id_col, spans`` (array of kind, start, end by start, then kind as listed)."""
    scratch = Scratch(df.sparkSession, "pii")
    rows, spans = occurrences(df, id_col, text_col, scratch)
    learned = bootstrap(df, text_col, spans, scratch, rounds, support, confident, accept)
    order = F.array_position(F.array(*[F.lit(k) for k in [*KINDS, LEARNED]]), F.col("kind"))
    every = spans.where("kind <> 'token'").select("row", "kind", "start", "end").unionByName(
        learned.withColumn("kind", F.lit(LEARNED)))
    listed = every.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("start", order.alias("rank"), "kind", "end"))).alias("spans"))
    return rows.join(listed, "row", "left").select(F.col("id").alias(id_col), F.transform(
        F.coalesce("spans", F.array()), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
