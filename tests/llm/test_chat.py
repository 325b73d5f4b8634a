"""Chat formatting: exact round trips, and path choice against brute force."""

import random

import pytest

from tessera.llm.chat import as_replies, escape, format_conversations, format_turns, parse_turns, read_back, unescape
from tessera.llm.q_chat import chat_digests

NASTY = ["", "\\", "\\\\", "### ", "\\### Assistant: </turn> ok", "</turn>", "\\</turn>\n### user: x", "#### ", "### ### ", "a:b\\:c", "</turn></turn>\\", "😀é\n"]


@pytest.mark.parametrize("seed", range(4))
def test_round_trip(seed):
    rng = random.Random(seed)
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant", "sys:tem\\", "", "### "]), "".join(rng.choice(NASTY) for _ in range(rng.randrange(5))))
                 for _ in range(rng.randrange(6))]
        text, spans = format_turns(turns)
        assert parse_turns(text) == turns
        assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        for _, t in turns:
            assert unescape(escape(t)) == t


def paths(messages, top):
    """(tree, leaf) -> texts, by walking up from every leaf."""
    out = {}
    for tree in {m[0] for m in messages}:
        nodes = {m[1]: m for m in messages if m[0] == tree}
        found = {}
        for leaf in nodes:
            if any(m[2] == leaf for m in nodes.values()):
                continue
            chain, at = [], leaf
            while at is not None and at in nodes and at not in chain:
                chain.append(at)
                at = nodes[at][2]
            if at in chain:
                continue
            chain.reverse()
            mean = round(sum(nodes[n][5] for n in chain) / len(chain), 9)
            found.setdefault(chain[0], []).append((-mean, leaf, [nodes[n][4] for n in chain]))
        for group in found.values():
            for _, leaf, texts in sorted(group)[:top]:
                out[tree, leaf] = texts
    return out


@pytest.mark.parametrize("top", [1, 3])
def test_reply_trees(spark, top):
    rng = random.Random(top)
    messages = []
    for tree in range(6):
        for node in range(rng.choice([1, 5, 40])):
            parent = rng.choice([None, 999] if node == 0 else [node - 1, node - 1, rng.randrange(node), None if rng.random() < .1 else node - 1])
            messages.append((tree, node, parent, rng.choice(["user", "assistant"]), f"t{tree}n{node}", float(rng.randrange(4))))
    messages += [(9, 0, 1, "user", "cycle", 1.0), (9, 1, 0, "user", "cycle", 1.0)]
    messages += [(10, n, n - 1 if n else None, "user", f"deep{n}", 0.0) for n in range(70)]
    df = spark.createDataFrame(messages, "tree long, node long, parent long, role string, text string, score double")
    out = format_conversations(df, top).collect()
    got = {(r.tree, r.leaf): [t for _, t in parse_turns(r.formatted)] for r in out}
    assert got == paths(messages, top) and len(out) == len(got)


def test_nulls_ties_repeats_and_empty_table(spark):
    rows = [(1, 2, "assistant", None, 0), (1, None, None, "first", 0), (1, 2, "assistant", "b", 0), (None, 1, "user", "x", 0), (1, 2, "assistant", "b", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")
    got = {r.tree: ([tuple(t) for t in r.turns], r.loss_text) for r in read_back(format_conversations(as_replies(df))).collect()}
    assert got[1] == ([("", "first"), ("assistant", ""), ("assistant", "b"), ("assistant", "b")], "bb")
    assert got[None] == ([("user", "x")], "")
    only = chat_digests(df.limit(0)).collect()
    assert [r.conv_id for r in only] == [-7] and only[0].n_turns == 2
