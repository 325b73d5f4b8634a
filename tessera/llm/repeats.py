"""Removal of long byte strings that occur more than once, across all documents.

Every byte covered by a string of ``length`` bytes that also starts anywhere else is removed.
The suffixes are never sorted as a whole. They are interleaved by what they have in common,
in rounds; each round looks at longer common strings, for the intervals still undecided:

1. Shards (tasks) pick an anchor for each window of ``length`` bytes: its smallest hashed
   ``K``-gram. Equal windows have equal anchors at equal places, so a window can only repeat
   at occurrences of its own anchor. A run of neighbouring windows with one anchor is an
   interval; its context is the text that the run covers. One row for each run (about one
   for 64 bytes) goes to the merge.
2. Anchors that occur once are done: nothing in their intervals repeats. Contexts that
   occur more than once are done as well: all their windows repeat.
3. What remains (an anchor with several contexts, such as at the ends of a shared passage) is
   refined: each interval is cut into nodes of 16, then 4, then 1 window, at fixed distances
   from the anchor. A node whose covered text occurs in another context repeats as a whole; one whose
   common core occurs in no other context has no repeat; the rest go to the next round.

Texts are compared by 64-bit hashes of whole strings (polynomial prefix sums, mixed). Counts are grouped sums with
map-side combining: a passage in a third of all documents is one row for each task and
anchor before the shuffle; joins back have one row on one side and can be split by Spark.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; matches never
cross documents; copies (also rows that repeat an identifier) are other places to start;
a null identifier is allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .scratch import Scratch
from .shingles import mix

#: Bytes of an anchor; windows in a piece of text worked on at a time; windows in a node, by round.
K, PIECE, NODES = 73, 1 << 20, (16, 4, 1)
PLACE = np.uint64((1 << 28) - 1)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    shingles._tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(shingles._CODES[data] * shingles._powers[:len(data)], out=out[1:])
    return out


def string_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Hashes of the strings [start, end), each with a number that equal strings must share."""
    return mix(mix((prefix[end] - prefix[start]) * shingles._inverse[start]) + mix(tag.astype(np.uint64)))


def runs(data: np.ndarray, first: np.ndarray, count: np.ndarray, length: int, k: int):
    """Runs of windows with one anchor. ``first`` and ``count``: where the windows of each text start in ``data``.

    Gives (text, first window, number, anchor's place, anchor's hash, context's hash)."""
    n = len(data) - k + 1
    prefix = prefix_hashes(data)
    grams = mix((prefix[k:] - prefix[:n]) * shingles._inverse[:n])
    low = (grams & ~PLACE) | np.arange(n, dtype=np.uint64)  # smallest hash, then leftmost
    width, span = length - k + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:span - width], low[width - span:])
    starts = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    anchor = (low[starts] & PLACE).astype(np.int64)
    text = np.repeat(np.arange(len(first)), count)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(text) != 0))))
    n_windows = np.diff(np.concatenate((new, [len(starts)])))
    at, place = starts[new], anchor[new]
    context = string_hashes(prefix, at, at + n_windows - 1 + length, (place - at) * 65536 + n_windows)
    return text[new], at, n_windows, place, grams[place], mix(context ^ mix(grams[place]))


def _anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Rows (id, th, anchor, context, a, n, off): windows a .. a + n - 1 of a text, whose anchor is at a + off."""
    kind = docs.schema["id"].dataType.simpleString()

    def merge(pieces, ids, hashes):
        data = np.frombuffer(b"".join(p[1] for p in pieces), np.uint8)
        sizes = np.array([len(p[1]) for p in pieces])
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        text, at, n, place, anchor, context = runs(data, first, sizes - length + 1, length, k)
        row = pa.array([p[0] for p in pieces]).take(pa.array(text))
        shift = np.array([p[2] for p in pieces]) - first
        return pa.RecordBatch.from_arrays(
            [ids.take(row), hashes.take(row), pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)),
             pa.array(at + shift[text], pa.int64()), pa.array(n, pa.int32()), pa.array(place - at, pa.int32())],
            names=["id", "th", "anchor", "context", "a", "n", "off"])

    def work(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(1)
            pieces, size = [], 0
            for row, value in enumerate(batch.column(2)):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                for s in range(0, len(data) - length + 1, PIECE):  # a longer text in pieces that share no window
                    piece = data[s:s + PIECE + length - 1]
                    pieces.append((row, piece, s))
                    size += len(piece)
                    if size >= PIECE:
                        yield merge(pieces, ids, hashes)
                        pieces, size = [], 0
            if pieces:
                yield merge(pieces, ids, hashes)

    return docs.mapInArrow(work, f"id {kind}, th int, anchor long, context long, a long, n int, off int")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Rows (context, n, off, data): the text of each wanted context, from the one occurrence that stands for it."""
    lists = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("context", "a", "n", "off")).alias("runs"))
    rows = docs.join(lists, docs["id"].eqNullSafe(lists["id"]) & (docs["th"] == lists["th"])).select("runs", "text")

    def work(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                data = batch.column(1)[one].as_buffer().to_pybytes()
                found = batch.column(0)[one].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["context"] for r in found], pa.int64()), pa.array([r["n"] for r in found], pa.int32()),
                     pa.array([r["off"] for r in found], pa.int32()),
                     pa.array([data[r["a"]:r["a"] + r["n"] - 1 + length] for r in found], pa.binary())],
                    names=["context", "n", "off", "data"])

    return rows.mapInArrow(work, "context long, n int, off int, data binary")


def _nodes(contexts: DataFrame, size: int, length: int) -> DataFrame:
    """Rows (context, node, lo, hi, full, core): nodes of ``size`` windows, lo .. hi by distance from the anchor.
    ``contexts`` may list the nodes of the round before (``parents``, of ``within`` windows) to which they are confined."""
    within = "parents" in contexts.columns

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                context, n, off = (np.asarray(part.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("context", "n", "off"))
                texts = part.column("data").to_pylist()
                base = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1])).astype(np.int64)
                prefix = prefix_hashes(np.frombuffer(b"".join(texts), np.uint8))
                least, most = off - n + 1, off  # distances from the anchor
                first = least // size
                each = most // size - first + 1
                owner = np.repeat(np.arange(len(n)), each)
                node = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + first[owner]
                if within:
                    old = part.column("parents").to_pylist()
                    ratio = part.column("within")[0].as_py() // size
                    keep = np.array([x // ratio in s for s, x in zip((set(old[o]) for o in owner), node)], bool) if len(owner) else np.zeros(0, bool)
                    owner, node = owner[keep], node[keep]
                lo, hi = np.maximum(least[owner], node * size), np.minimum(most[owner], node * size + size - 1)
                place = (base + off)[owner]
                full = string_hashes(prefix, place - hi, place - lo + length, (lo * 4096 + hi) * 2)
                core = string_hashes(prefix, place - node * size, place - node * size - size + 1 + length, (node * 64 + size) * 2 + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(context[owner]), pa.array(node.astype(np.int32)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                     pa.array(full.view(np.int64)), pa.array(core.view(np.int64))], names=["context", "node", "lo", "hi", "full", "core"])

    return contexts.mapInArrow(work, "context long, node int, lo int, hi int, full long, core long")


def _mark(nodes: DataFrame) -> DataFrame:
    """Adds ``all`` (the whole text of the node is in another context too) and ``lead`` (the context that stands for those)."""
    twice = (nodes.groupBy("full").agg(F.min("context").alias("x"), F.max("context").alias("y"))
             .where("x <> y").select(F.col("full").alias("k"), "x"))
    return (nodes.join(twice, F.col("full") == F.col("k"), "left")
            .withColumn("all", F.col("k").isNotNull()).withColumn("lead", F.coalesce(F.col("x") == F.col("context"), F.lit(False))).drop("k", "x"))


def _undecided(marked: DataFrame) -> DataFrame:
    """Nodes for the next round: their core is in several contexts, and for one of these that is not enough.
    Of contexts with one full text, one goes on, for the others to meet it."""
    cores = (marked.groupBy("core").agg(F.min("context").alias("x"), F.max("context").alias("y"), F.min("all").alias("clear"))
             .where("x <> y and not clear").select(F.col("core").alias("k")))
    return marked.where("lead or not all").join(cores, F.col("core") == F.col("k"), "left_semi").select("context", "node")


def repeated_spans(docs: DataFrame, length: int, k: int, scratch: Scratch) -> DataFrame:
    """Rows (id, th, start, end): spans made of windows that start elsewhere too; docs is (id, th, text)."""
    rows = scratch.keep(_anchors(docs, length, k), "anchors")
    per = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("many"), F.min("context").alias("x"), F.max("context").alias("y")).where("many > 1")
    per = scratch.keep(per.selectExpr("anchor AS k", "x <> y AS mixed"), "repeated_anchors")
    rows = scratch.keep(rows.join(per, F.col("anchor") == F.col("k")).drop("k", "anchor"), "occurrences")
    scratch.drop("anchors", "repeated_anchors")
    stands = F.min(F.struct("id", "th", "a", "n", "off"))
    kinds = scratch.keep(rows.groupBy("context", "mixed").agg(F.count(F.lit(1)).alias("many"), stands.alias("one")), "kinds")
    scratch.tidy()
    texts = scratch.keep(_contexts(docs, kinds.where("mixed").select("context", "one.*"), length), "texts")
    scratch.tidy()
    todo, done = texts, []
    for i, size in enumerate(NODES):
        nodes = scratch.keep(_nodes(todo, size, length), f"nodes{i}")
        marked = scratch.keep(_mark(nodes), f"marked{i}")
        done.append(marked.where("all").select("context", "lo", "hi"))
        if i + 1 < len(NODES):
            todo = texts.join(_undecided(marked).groupBy("context").agg(F.collect_list("node").alias("parents"))
                              .withColumn("within", F.lit(size)), "context")
        scratch.drop(f"nodes{i}")
        scratch.tidy()
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    single = kinds.where("mixed and many = 1").select("context", "one.*")
    partly = single.join(found, "context").selectExpr("id", "th", "a + off - hi AS start", f"a + off - lo + {length} AS end")
    wholly = rows.join(kinds.where("many > 1").select(F.col("context").alias("k")), F.col("context") == F.col("k"), "left_semi").selectExpr(
        "id", "th", "a AS start", f"a + n - 1 + {length} AS end")
    return partly.unionByName(wholly)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, k: int = K) -> DataFrame:
    """One row per input row: ``id_col, n_bytes, spans`` (removed runs: start, end in bytes), ``kept`` (remaining bytes, binary)."""
    if not 1 <= k <= length - NODES[0]:
        raise ValueError("k must leave room for windows")
    scratch = Scratch(df.sparkSession, "repeats")
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.select("id", F.hash("text").alias("th"), F.encode("text", "UTF-8").alias("text"))
    spans = scratch.keep(repeated_spans(docs, length, k, scratch), "spans")
    scratch.drop("occurrences", "kinds", "texts", *[f"marked{i}" for i in range(len(NODES))])
    lists = spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    full = docs.alias("d").join(lists.alias("l"), F.col("d.id").eqNullSafe(F.col("l.id")) & (F.col("d.th") == F.col("l.th")), "left").select(
        F.col("d.id").alias("id"), "text", "cuts")
    kind = df.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                size, spans, kept = [], [], []
                for value, cuts in zip(part.column(1), part.column(2)):
                    data = value.as_buffer().to_pybytes()
                    size.append(len(data))
                    merged = _union(cuts.values if cuts.is_valid else None)
                    spans.append([{"start": s, "end": e} for s, e in merged])
                    edges = [0, *(x for pair in merged for x in pair), len(data)]
                    kept.append(b"".join(data[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                                                 names=["id", "n_bytes", "spans", "kept"])

    return full.mapInArrow(work, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("id", id_col)


def _union(cuts) -> list[tuple[int, int]]:
    """Maximal runs of a list of overlapping or touching spans."""
    if cuts is None or not len(cuts):
        return []
    start, end = (np.asarray(cuts.field(f).to_numpy(zero_copy_only=False), np.int64) for f in ("start", "end"))
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return list(zip(start[new].tolist(), reach[np.concatenate((new[1:], [len(start)])) - 1].tolist()))
