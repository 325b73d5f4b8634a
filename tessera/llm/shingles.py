"""Sets of word shingles as 64-bit hashes, many texts at a time, in numpy.

Words are runs of anything but ASCII white space, A-Z lower-cased. A shingle's hash is
that of its words joined by one blank: a polynomial over random byte codes modulo 2**64,
taken from prefix sums (so one pass over the bytes serves all shingles) and then mixed.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text hashed at a time; a longer text is a piece of its own.
PIECE = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_CODES = _rng.integers(1, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(1, 1 << 64, dtype=np.uint64)) | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> None:
    """Powers of the base and of its inverse up to exponent n."""
    global _powers, _inverse
    if len(_powers) <= n:
        n = max(n, 2 * PIECE)
        for name, base in (("_powers", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _piece(texts: list[list[bytes]], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each list of words."""
    joined = b"".join(b" ".join(w) + b" " for w in texts if w)
    data = np.frombuffer(joined, np.uint8)
    _tables(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * _powers[:len(data)], out=prefix[1:])
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    out, at = [], 0
    for w in texts:
        n = len(w)
        if not n:
            out.append(np.empty(0, np.uint64))
            continue
        size = min(k, n)
        first, last = starts[at:at + n - size + 1], ends[at + size - 1:at + n]
        out.append(np.unique(mix((prefix[last] - prefix[first]) * _inverse[first])))
        at += n
    return out


def shingle_sets(texts, k: int = 5):
    """Yield the sorted distinct shingle hashes (uint64) of each text; null and blank texts have none."""
    waiting, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        waiting.append(data.split())
        size += len(data)
        if size >= PIECE:
            yield from _piece(waiting, k)
            waiting, size = [], 0
    if waiting:
        yield from _piece(waiting, k)
