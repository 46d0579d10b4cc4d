"""Text as arrays: the numpy steps that several operators run over Arrow batches.

Each function takes a run of whole texts as one byte array with offsets.  Runs
are cut to about ``RUN_BYTES``; a longer text is a run of its own, so memory is
bounded by that size or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 2_000_000
U64 = np.uint64

_rng = np.random.default_rng(20240607)
BYTE_CODES = _rng.integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the published splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for a run; only a text longer than a run has a table of its own."""
    return _usual() if bits <= 21 else _table(bits)


@lru_cache(maxsize=1)
def _usual() -> tuple[np.ndarray, np.ndarray]:
    return _table(21)


def _table(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (_BASE, _BACK):
        p = np.ones(n, dtype=U64)
        p[1:] = base
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Spans:
    """Hashes of any spans of a byte array in constant time each (mod 2**64)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        fore, self._back = _powers(max(n, 1).bit_length())
        self._sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(BYTE_CODES[data] * fore[:n], out=self._sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self._sums[end] - self._sums[start]) * self._back[start]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(U64))


def runs(text: pa.Array, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; NULL is empty."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    n = len(text)
    if not n:
        return
    offs = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + n + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (no ASCII white space inside), and for each
    text the place of its first word; words never cross texts."""
    solid = ~SPACE[data]
    full = offs[:-1] < offs[1:]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        at = offs[:-1][full]
        first[at] = solid[at]
        at = offs[1:][full] - 1
        last[at] = solid[at]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offs)


def shingles(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of each text, and each text's offset.

    A text of fewer words than ``n`` has one shingle of all its words, an empty
    one none.  A shingle met twice in a text comes twice.
    """
    start, end, per_text = word_spans(data, offs)
    words = Spans(data)(start, end)
    w = len(words)
    out = np.zeros(w, dtype=U64)
    for j in range(min(n, w)):
        out[: w - j] = (out[: w - j] ^ words[j:]) * U64(0xD6E8FEB86659FD93) + U64(j + 1)
    left = np.repeat(per_text[1:], np.diff(per_text)) - np.arange(w)
    keep = left >= n
    sizes = np.diff(per_text)
    for t in np.flatnonzero((sizes > 0) & (sizes < n)):
        lo, hi = per_text[t], per_text[t + 1]
        h = U64(hi - lo)
        for x in words[lo:hi]:
            h = np.multiply(h ^ x, U64(0xC2B2AE3D27D4EB4F))
        out[lo], keep[lo] = h, True
    at = np.flatnonzero(keep)
    return mix(out[at]), np.searchsorted(at, per_text)


def lower_text(text: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), ""))
