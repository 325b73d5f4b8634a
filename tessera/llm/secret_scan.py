"""Secrets in texts: fixed patterns, and windows of high entropy over candidate strings.

Fixed patterns (the base) are assignments to names such as ``password``, access keys and long hex runs. Beyond
these, every run of at least ``SHORTEST`` characters of which keys are made is a candidate. For each
character class, a window slides over the parts of the candidate that consist of the class. The window's Shannon entropy is
log2(w) - sum(n * log2(n)) / w over the counts n of its characters; a step changes two counts, so the sum is
updated by four table entries, as whole numbers that do not drift. Windows at or above the class's threshold are
united to spans, so a long string costs one pass whatever its length.

Suppressed are spans without a digit or without a letter (words, card numbers), spans that overlap one
already found, and spans of the allow-list: candidates with an allowed value, matched by an allowed pattern, or
after an allowed context (checksums, commits, UUIDs, alphabets, placeholders by default).

Rows are scanned one by one in Arrow batches; nothing is gathered or shuffled, and a lost task is run again.

Defined cases: a null text is empty; places are code points, end exclusive; texts are whole, of any length; rows
that repeat an identifier each get theirs; an empty table gives an empty result; output columns are fixed, all others are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
SHORTEST, LEAST_VALUE, ROWS, UNIT = 16, 12, 250, 1 << 32
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")


@dataclass(frozen=True)
class CharacterClass:
    """Windows of ``width`` characters of the class with an entropy of ``bits`` or more are suspicious."""
    kind: str
    members: str
    width: int
    bits: float


CLASSES = (
    CharacterClass("entropy_hex", "[0-9A-Fa-f]", 20, 3.0),
    CharacterClass("entropy_base64", "[A-Za-z0-9+/]", 20, 3.75),
    CharacterClass("entropy_url", "[A-Za-z0-9_-]", 20, 3.75),
)


@dataclass(frozen=True)
class AllowList:
    """What is no secret: whole candidates by value, patterns that occur in one, and contexts that end where it begins."""
    values: tuple[str, ...] = ()
    patterns: tuple[str, ...] = (
        r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", r"(?i)example|placeholder|changeme|your[_-]?(?:key|token|secret)",
        r"(?i)abcdefghij|0123456789|qwertyuiop|(.)\1{7}")
    contexts: tuple[str, ...] = (r"(?i)\bsha-?(?:1|224|256|384|512)[-:=]\s*$", r"(?i)\b(?:commit|revision|checksum|digest|etag)[:=]?\s+$")


def high_entropy(text: str, width: int, bits: float) -> Iterator[tuple[int, int]]:
    """Maximal runs of ``text`` that windows of at least ``bits`` cover."""
    if len(text) < width:
        return
    weigh = [0, *(round(n * math.log2(n) * UNIT) for n in range(1, width + 2))]  # a step adds before it takes away
    most = math.floor((math.log2(width) - bits) * width * UNIT + width)  # of the sum; the rest is for the table's rounding
    counts, total, begun, upto = {}, 0, -1, -1
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c], total = n + 1, total + weigh[n + 1] - weigh[n]
        if i >= width:
            gone = text[i - width]
            n = counts[gone]
            counts[gone], total = n - 1, total + weigh[n - 1] - weigh[n]
        start = i - width + 1
        if start >= 0 and total <= most:
            if start > upto:
                if begun >= 0:
                    yield begun, upto
                begun = start
            upto = i + 1
    if begun >= 0:
        yield begun, upto


class Scanner:
    def __init__(self, classes: tuple[CharacterClass, ...] = CLASSES, allow: AllowList = AllowList()):
        self.classes = [(c, re.compile(f"{c.members}{{{c.width},}}")) for c in classes]
        self.values = frozenset(allow.values)
        self.patterns = [re.compile(p) for p in allow.patterns]
        self.contexts = [re.compile(p) for p in allow.contexts]
        self.order = {k: i for i, k in enumerate([*BASE, *(c.kind for c in classes)])}

    def allowed(self, text: str, start: int, end: int) -> bool:
        value, before = text[start:end], text[max(0, start - 40):start]
        return value in self.values or any(p.search(value) for p in self.patterns) or any(p.search(before) for p in self.contexts)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind), by start, then kind."""
        low, out = text.lower(), []
        if any(name in low for name in NAMES):
            out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
        if "AKIA" in text:
            out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
        runs = [m.span() for m in CANDIDATE.finditer(text)]
        out += [(*m.span(), "hex") for a, b in runs for m in HEX.finditer(text, a, b)]
        return sorted(out + self.added(text, runs, out), key=lambda s: (s[0], self.order[s[2]]))

    def added(self, text: str, runs: list[tuple[int, int]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """High-entropy spans of the candidates that overlap neither ``base`` nor each other."""
        made, covered = [], None
        for a, b in runs:
            allowed = None
            for c, expression in self.classes:
                for m in expression.finditer(text, a, b):
                    for s, e in high_entropy(m[0], c.width, c.bits):
                        s, e = s + m.start(), e + m.start()
                        value = text[s:e]
                        if not re.search("[0-9]", value) or not re.search("[A-Za-z]", value):
                            continue
                        if covered is None:
                            covered = bytearray(len(text))
                            for at, upto, _ in base:
                                covered[at:upto] = b"\x01" * (upto - at)
                        if 1 in covered[s:e]:
                            continue
                        allowed = self.allowed(text, a, b) if allowed is None else allowed
                        if not allowed:
                            covered[s:e] = b"\x01" * (e - s)
                            made.append((s, e, c.kind))
        return made


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharacterClass, ...] = CLASSES,
                allow: AllowList = AllowList()) -> DataFrame:
    """One row per input row: ``id_col, spans`` (array of kind, start, end by start, then kind) and ``redacted`` (the text
    with each span replaced by ``[secret]``)."""
    kind = df.schema[id_col].dataType.simpleString()

    def scan(batches):
        scanner = Scanner(classes, allow)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found, clean = [], []
                for value in part.column("text"):
                    text = value.as_py() or ""
                    spans = scanner.spans(text)
                    found.append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
                    clean.append(redact(text, spans))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, SPANS), pa.array(clean, pa.string())],
                                                 names=["id", "spans", "redacted"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>, redacted string").withColumnRenamed("id", id_col)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with ``[secret]`` for each run of overlapping spans."""
    out, upto, begun = [], 0, False
    for start, end, _ in spans:
        if not begun or start >= upto:
            out += [text[upto:start], "[secret]"]
            begun = True
        upto = max(upto, end)
    return "".join([*out, text[upto:]]) if spans else text
