"""Byte-level BPE: encode texts to rank ids and decode ids back to bytes.

A pre-token is merged with a hierarchical-bitmap rank queue. There is one bucket for
each merge rank that some adjacent pair has; a bucket holds the linked-list positions
of its pairs, leftmost first. Two levels of 256-bit words say which buckets are not
empty, so the next rank is two find-first-set steps, whatever the length. An entry
whose position has meanwhile another pair is stale and is skipped. A pre-token of n
bytes costs O(n log n) at most: one of a megabyte is no special case. All new pre-tokens
of a batch share one queue: the lowest rank of all is the lowest of each that has it.

Texts are first cut at every space that is followed by the next chunk; the pattern can
never match across such a cut, so equal chunks have equal ids and each worker remembers
those it used last (``CACHE`` bytes of chunks and pre-tokens, until other work claims the worker). Rows are encoded one by
one inside Arrow batches; nothing is gathered, and a lost task is simply run again.

Defined cases: a null text is the empty text and has no ids; texts are whole, of any
length; special-token strings are ordinary text; output columns replace input columns
of the same name; all other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .worker import claim

#: Bytes (as estimated by ``_Recent``) of chunks, and again of pre-tokens, that a worker remembers, and rows it turns into
#: one output batch. The texts of a 16 MB Parquet split need some 80 MB of chunks.
CACHE, ROWS = 88 << 20, 200
#: Code points or bytes a task must have seen for its caches to outlive it: among short tasks Spark keeps spare workers waiting, and
#: each would hold caches of its own.
WORTH = 8 << 20
BIT = [1 << i for i in range(1 << 12)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token, blank, rank. It is read on the driver and sent to the tasks (under 2 MB)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder for one vocabulary, with what it has seen last."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pairs = np.full(1 << 16, -1, np.int64)  # rank of each two bytes
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.split = regex.compile(pattern).findall
        self.words = [0] * ((len(self.tokens) >> 8) + 1)  # of the queue: a bit for each bucket; all 0 between calls
        self.chunks, self.pieces = _Recent(), _Recent()

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each pre-token. All lie one after the other in one list of positions, with an edge
        between them that no pair crosses, and share one queue: a bucket has the positions of all of them."""
        data = b"\0" + b"\0".join(pieces) + b"\0"
        n, get, words = len(data), self.ranks.get, self.words
        ends = np.cumsum([0, *(len(p) + 1 for p in pieces)])
        edge = np.zeros(n, bool)
        edge[ends] = True
        codes = np.frombuffer(data, np.uint8).astype(np.int64)
        first = self.pairs[codes[:-1] << 8 | codes[1:]]
        first[edge[:-1] | edge[1:]] = -1
        pair = [*first.tolist(), -1]
        held = np.flatnonzero(first >= 0)
        held = held[np.argsort(first[held], kind="stable")]
        cuts = np.flatnonzero(np.diff(first[held], prepend=-1))
        buckets = {first[held[c]].item(): held[c:e].tolist() for c, e in zip(cuts, [*cuts[1:], len(held)])}
        edge, after, before = edge.tobytes(), list(range(1, n + 1)), list(range(-1, n - 1))
        top = 0
        for rank in buckets:
            words[rank >> 8] |= BIT[rank & 255]
            top |= BIT[rank >> 8]
        while top:
            low = (top & -top).bit_length() - 1  # find first set, twice
            bits = words[low]
            rank = (low << 8) + (bits & -bits).bit_length() - 1
            words[low] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            bucket = buckets.pop(rank)
            bucket.sort()
            for k, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale: the position has another pair now, or was merged away
                gone = after[i]
                right = after[i] = after[gone]
                pair[gone] = pair[i] = -1
                left, lower = before[i], False
                if not edge[right]:
                    before[right] = i
                    pair[i] = new = get(data[i:after[right]], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            buckets[new] = [i]
                            words[new >> 8] |= BIT[new & 255]
                            top |= BIT[new >> 8]
                        lower = new <= rank
                if not edge[left]:
                    pair[left] = new = get(data[left:right], -1)
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            buckets[new] = [left]
                            words[new >> 8] |= BIT[new & 255]
                            top |= BIT[new >> 8]
                        lower = lower or new <= rank
                if lower:  # a new pair comes first: the rest of the bucket waits
                    buckets[rank] = bucket[k + 1:] + buckets.get(rank, [])
                    if buckets[rank]:
                        words[rank >> 8] |= BIT[rank & 255]
                        top |= BIT[rank >> 8]
                    else:
                        del buckets[rank]
                    break
        out, i = [], 1
        for end in ends[1:].tolist():
            ids = []
            while i < end:
                ids.append(get(data[i:after[i]]))
                i = after[i]
            out.append(_packed(ids))
            i += 1
        return out

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Packed ids of texts none of which needs a cut at blanks; remembers them."""
        split = {c: self.split(c) for c in chunks}
        known, new = {}, []
        for piece in {p for ps in split.values() for p in ps}:
            ids = self.pieces.find(piece)
            if ids is None:
                new.append(piece)
            else:
                known[piece] = ids
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        todo = [i for i, r in enumerate(raw) if r not in self.ranks]
        made = {new[i]: _packed([self.ranks[r]]) for i, r in enumerate(raw) if r in self.ranks}
        made.update(zip((new[i] for i in todo), self.merge([raw[i] for i in todo])))
        self.pieces.add(made)
        known.update(made)
        return {c: b"".join([known[p] for p in ps]) for c, ps in split.items()}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Texts are cut before each blank that a word follows: always a boundary. A chunk is known by what follows the blank.
        """
        cut, fresh, known = [], set(), {}
        for text in texts:
            first, *rest = (text or "").split(" ")
            cut.append((first, rest))
            fresh.update(rest)
        white = {c for c in fresh if not c or c[0].isspace()}  # after a blank: such a cut may be no boundary
        if white or not all(f for f, _ in cut):
            fresh -= white
            for i, (first, rest) in enumerate(cut):
                if rest and not (first and white.isdisjoint(rest)):
                    parts = regex.split(r"(?= \S)", texts[i], flags=regex.V1)
                    cut[i] = parts[0], [p[1:] for p in parts[1:]]
                    fresh.update(cut[i][1])
        for chunk in fresh:
            ids = self.chunks.find(chunk)
            if ids is not None:
                known[chunk] = ids
        missing = [c for c in fresh if c not in known]
        heads = {f for f, _ in cut if f}
        learned = self._learn({" " + c for c in missing} | heads)
        made = {c: learned[" " + c] for c in missing}
        self.chunks.add(made)
        known.update(made)
        return [(learned[f] if f else b"") + b"".join(map(known.__getitem__, rest)) for f, rest in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _packed(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class _Recent:
    """What was used last: at least ``CACHE`` bytes of entries, at most about twice as many."""

    def __init__(self):
        self.new, self.old, self.size = {}, {}, 0

    def find(self, key: str) -> bytes | None:
        ids = self.new.get(key)
        if ids is None and (ids := self.old.pop(key, None)) is not None:
            self._keep(key, ids)
        return ids

    def add(self, entries: dict[str, bytes]) -> None:
        if self.size >= CACHE:
            self.new, self.old, self.size = {}, self.new, 0
        for key, ids in entries.items():
            if len(key) < 64:
                self._keep(key, ids)

    def _keep(self, key: str, ids: bytes) -> None:
        self.new[key] = ids
        self.size += 190 + len(key) + len(ids)  # both objects and the place in the dictionary


_codecs: dict[str, Codec] = {}


def _codec(key: str, shared, pattern: str) -> Codec:
    """One codec for all tasks of a worker, until it does other work."""
    claim("bpe", _codecs.clear)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value, pattern)
    return _codecs[key]


def _vocabulary(df: DataFrame, ranks: dict[bytes, int], pattern: str):
    """The vocabulary for tasks, and a name that tells it from others."""
    named = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()
    return named, df.sparkSession.sparkContext.broadcast(ranks)


def _mapped(df: DataFrame, source: str, outputs: list[T.StructField], work) -> DataFrame:
    """Append (or replace) columns that ``work(values) -> list of columns`` makes of one column."""
    made = {f.name.lower() for f in outputs}
    stay = [c for c in df.columns if c.lower() not in made]
    spare = source if source in stay else None
    frame = df if spare else df.withColumnRenamed(source, f"_in_{source}")
    name = spare or f"_in_{source}"
    schema = T.StructType([f for f in df.schema.fields if f.name in stay] + outputs)

    def batches(parts):
        seen = 0
        for batch in parts:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                columns = [piece.column(c) for c in stay]
                values = piece.column(piece.schema.get_field_index(name)).to_pylist()
                seen += sum(len(v) for v in values if v)
                yield pa.RecordBatch.from_arrays(columns + work(values), names=[f.name for f in schema.fields])
        if seen < WORTH:
            _codecs.clear()

    return frame.select(*[frame[c] for c in stay], *([] if spare else [frame[name]])).mapInArrow(batches, schema)


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text",
           ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col`` (binary): the ids as little-endian unsigned 32-bit integers."""
    key, shared = _vocabulary(df, ranks, pattern)

    def work(values):
        codec = _codec(key, shared, pattern)
        return [pa.array(codec.encode(values), pa.binary())]

    return _mapped(df, text_col, [T.StructField(ids_col, T.BinaryType())], work)


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text",
               ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass."""
    key, shared = _vocabulary(df, ranks, pattern)

    def work(values):
        codec = _codec(key, shared, pattern)
        ids = codec.encode(values)
        return [pa.array(ids, pa.binary()), pa.array([codec.decode(v) for v in ids], pa.binary())]

    return _mapped(df, text_col, [T.StructField(ids_col, T.BinaryType()), T.StructField(bytes_col, T.BinaryType())], work)


def decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, ids_col: str = "ids",
           bytes_col: str = "decoded") -> DataFrame:
    """Add ``bytes_col`` (binary): the bytes that the ids stand for."""
    key, shared = _vocabulary(df, ranks, pattern)

    def work(values):
        codec = _codec(key, shared, pattern)
        return [pa.array([codec.decode(v) if v else b"" for v in values], pa.binary())]

    return _mapped(df, ids_col, [T.StructField(bytes_col, T.BinaryType())], work)
