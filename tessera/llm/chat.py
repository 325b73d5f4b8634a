"""Chat formatting from reply trees.

Messages point to the message they answer. Iterated self-joins with pointer doubling give
every message its root, depth and the scores on its way (a tree of depth n takes log2 n
joins); the leaves of each root are ranked by the mean score of their path, and the
``top`` best paths are enumerated by joining the same jump tables downwards in size, so each
member of a path is found exactly once. Each path becomes one conversation.

Template: ``### role: text</turn>`` and a newline for each turn. Inside texts a backslash
is put before every backslash, ``### `` and ``</turn>``; in roles before every backslash and
colon. So a mark without backslash is always the template's, and reading back undoes it.
The loss mask is the list of spans (code points of the formatted string) of the escaped
assistant texts.

Defined cases: null texts and roles are empty; a parent that does not exist makes a root;
messages on a cycle have no root and are left out; equal scores are ranked by the leaf's
identifier; equal turns of a conversation are ordered by role and text; other columns are
ignored; an empty table gives an empty result. A conversation is one string, so one row
holds one path; nothing else is gathered.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

CONTROL = re.compile(r"\\|### |</turn>")
_ESCAPED = re.compile(r"\\(\\|### |</turn>)")
_STOP = re.compile(r"\\(?:\\|### |</turn>)|(</turn>)")
_HEAD = re.compile(r"### ((?:\\.|[^\\:])*): ", re.S)
SPOKEN = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], spoken: str = SPOKEN) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and its loss spans."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = "### " + re.sub(r"[\\:]", r"\\\g<0>", role) + ": "
        body = escape(text)
        if role == spoken:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, "</turn>\n")
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    turns, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        end = next(m for m in _STOP.finditer(formatted, head.end()) if m[1])
        turns.append((re.sub(r"\\(.)", r"\1", head[1], flags=re.S), unescape(formatted[head.end():end.start()])))
        at = end.end() + 1
    return turns


def as_replies(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """Linear conversations as messages (tree, node, parent, role, text, score): each turn answers the one before."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    node = F.row_number().over(order)
    return (conversations.select(F.col(id_col).alias("tree"), F.col(turn_col).alias("turn"),
                                 F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .withColumn("node", node.cast("long"))
            .select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")))


def _links(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jumps of one step, roots): a message whose parent is missing is a root."""
    known = messages.select(F.col("tree").alias("t"), F.col("node").alias("there"))
    both = messages.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("there")), "left")
    score = F.col("score").cast("double")
    return (both.where("there is not null").select("tree", "node", F.col("there").alias("jump"), score.alias("total")),
            both.where("there is null").select(F.col("tree").alias("rt"), F.col("node").alias("root"), score.alias("own")))


def _up(table: DataFrame) -> DataFrame:
    return table.select(F.col("tree").alias("t"), F.col("node").alias("at"), F.col("jump").alias("above"), F.col("total").alias("gain"))


def jumps(steps: DataFrame, size: int, scratch: Scratch) -> list[DataFrame]:
    """Jump tables (tree, node, jump, total): the k-th has the messages with 2**k others above them, the message
    2**k up, and the scores in between. Each is the one before joined with itself, and smaller."""
    tables = [scratch.keep(steps, "jump0")]
    while 2 ** len(tables) < size:
        last = tables[-1]
        longer = (last.join(_up(last), F.col("tree").eqNullSafe(F.col("t")) & (F.col("jump") == F.col("at")))
                  .select("tree", "node", F.col("above").alias("jump"), (F.col("total") + F.col("gain")).alias("total")))
        longer = scratch.keep(longer, f"jump{len(tables)}")
        if not longer.limit(1).count():
            break
        tables.append(longer)
    return tables


def best_paths(messages: DataFrame, top: int, scratch: Scratch) -> DataFrame:
    """Rows (tree, leaf, rank, depth, node) of the ``top`` best paths of each root."""
    size = messages.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    steps, roots = _links(messages)
    tables = jumps(steps, size, scratch)
    answered = messages.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    climb = (messages.join(answered, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
             .select("tree", F.col("node").alias("leaf"), F.col("node").alias("now"), F.lit(0).cast("long").alias("depth"), F.lit(0.0).alias("sum")))
    for k in reversed(range(len(tables))):  # from every leaf to its root, by the largest jumps that there are
        climb = (climb.join(_up(tables[k]), F.col("tree").eqNullSafe(F.col("t")) & (F.col("now") == F.col("at")), "left")
                 .select("tree", "leaf", F.coalesce("above", "now").alias("now"),
                         (F.col("depth") + F.when(F.col("at").isNotNull(), 2 ** k).otherwise(0)).alias("depth"),
                         (F.col("sum") + F.coalesce("gain", F.lit(0.0))).alias("sum")))
    leaves = climb.join(roots, F.col("tree").eqNullSafe(F.col("rt")) & (F.col("now") == F.col("root"))).select(
        "tree", "root", "leaf", "depth", F.round((F.col("sum") + F.col("own")) / (F.col("depth") + 1), 9).alias("mean"))
    best = Window.partitionBy("tree", "root").orderBy(F.col("mean").desc(), "leaf")
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    members = scratch.keep(chosen.select("tree", "leaf", "rank", "depth", F.col("leaf").alias("node")), "path")
    for k in reversed(range(len(tables))):
        above = members.join(_up(tables[k]), F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("at"))).select(
            "tree", "leaf", "rank", (F.col("depth") - 2 ** k).alias("depth"), F.col("above").alias("node"))
        members = scratch.keep(members.unionByName(above), f"path{k}")
    return members


def format_conversations(messages: DataFrame, top: int = 1, spoken: str = SPOKEN) -> DataFrame:
    """Rows (tree, leaf, rank, formatted, loss): messages are (tree, node, parent, role, text, score)."""
    scratch = Scratch(messages.sparkSession, "chat")
    messages = scratch.keep(messages, "messages")
    members = best_paths(messages, top, scratch)
    said = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"),
                           F.coalesce("text", F.lit("")).alias("text"))
    paths = (members.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
             .groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns")))
    kinds = {c: paths.schema[c].dataType.simpleString() for c in ("tree", "leaf", "rank")}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", formatted string, loss array<struct<start:int,end:int>>"
    mask = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def work(batches):
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns], spoken) for turns in batch.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kinds] + [pa.array([m[0] for m in made], pa.string()),
                 pa.array([[{"start": a, "end": b} for a, b in m[1]] for m in made], mask)], names=[*kinds, "formatted", "loss"])

    return paths.mapInArrow(work, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Rows (tree, turns, loss_text, formatted) from the formatted strings and their loss spans alone."""
    kind = formatted.schema["tree"].dataType.simpleString()
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def work(batches):
        for batch in batches:
            texts, masks = batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()
            turns = [[{"role": r, "text": t} for r, t in parse_turns(x)] for x in texts]
            loss = ["".join(unescape(x[s["start"]:s["end"]]) for s in m) for x, m in zip(texts, masks)]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), pa.array(turns, turn), pa.array(loss, pa.string()),
                                              batch.column("formatted")], names=["tree", "turns", "loss_text", "formatted"])

    return formatted.select("tree", "formatted", "loss").mapInArrow(
        work, f"tree {kind}, turns array<struct<role:string,text:string>>, loss_text string, formatted string")
