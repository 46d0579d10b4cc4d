"""Periodic runs of words by block convolution.

A run is a stretch of words that repeats with a smallest period q for at least
``EXPONENT`` periods.  Scales are dyadic: at scale B, for the periods from B up to
2 B, the words are cut into blocks every B words.  A run of such a period holds
whole blocks, each of which comes again a period later; that place lies in the
window that follows the block.  The sums of squared differences between a block
and every place of its window are a correlation, which an integer number-theoretic
transform gives exactly: word codes are folded so that the largest sum stays
under the modulus.  Places of sum zero are the block's occurrences; a chain of
blocks at one distance seeds a run, and the words themselves decide where it ends.

A block with a word that does not come again within 2 B words cannot be such a
seed, so it is not transformed.  That loses no run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import free, id_crc, small_batches

EXPONENT = 4  # periods that a run has at least
LEAST = 6  # words that a run has at least
MODULUS, ROOT = 2013265921, 31  # 15 * 2**27 + 1 and a generator of its units
WIDEST = 1 << 15  # words of a block at most; wider scales take several windows a block
CELLS = 1 << 20  # numbers of a transform at once
_P = np.uint64(MODULUS)


@lru_cache(maxsize=64)
def _turns(n: int, back: bool) -> np.ndarray:
    """The first half of the powers of an n-th root of one."""
    w = pow(ROOT, (MODULUS - 1) // n, MODULUS)
    w = pow(w, -1, MODULUS) if back else w
    out = np.ones(max(n // 2, 1), dtype=np.uint64)
    size = 1
    while size < len(out):
        step = min(size, len(out) - size)
        out[size : size + step] = out[:step] * np.uint64(pow(w, size, MODULUS)) % _P
        size += step
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """The number-theoretic transform of each row, places in bit-reversed order."""
    rows, n = x.shape
    while n > 1:
        x = x.reshape(-1, n)
        a, b = x[:, : n // 2], x[:, n // 2 :]
        x = np.concatenate(((a + b) % _P, (a + (_P - b)) % _P * _turns(n, False) % _P), axis=1)
        n //= 2
    return x.reshape(rows, -1)


def transform_back(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`transform`."""
    rows, width = x.shape
    n = 2
    while n <= width:
        x = x.reshape(-1, n)
        a, b = x[:, : n // 2], x[:, n // 2 :] * _turns(n, True) % _P
        x = np.concatenate(((a + b) % _P, (a + (_P - b)) % _P), axis=1)
        n *= 2
    return x.reshape(rows, width) * np.uint64(pow(width, -1, MODULUS)) % _P


def differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences of each block (a row of b numbers) with its
    window (2 b - 1 or more numbers) at the places 0 to b - 1, exact while they are
    under the modulus."""
    m, b = blocks.shape
    width = 4 * b
    turned = np.zeros((m, width), dtype=np.uint64)
    turned[:, :b] = blocks[:, ::-1]
    ahead = np.zeros((m, width), dtype=np.uint64)
    ahead[:, : windows.shape[1]] = windows
    cross = transform_back(transform(turned) * transform(ahead) % _P)[:, b - 1 : 2 * b - 1]
    squares = np.zeros((m, windows.shape[1] + 1), dtype=np.uint64)
    np.cumsum(windows * windows, axis=1, out=squares[:, 1:])
    own = (blocks * blocks).sum(axis=1, keepdims=True)
    there = squares[:, b : 2 * b] - squares[:, :b]
    return (own % _P + there % _P + np.uint64(2) * (_P - cross)) % _P


def _occurrences(codes: np.ndarray, starts: np.ndarray, b: int, first: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(block start, distance) of places from ``first`` to ``first + b - 1`` words on
    at which a block of b words comes again."""
    fold = np.uint64(max(int((MODULUS / b) ** 0.5) - 1, 2))
    n = len(codes)
    at = max(1, CELLS // (4 * b))
    within = np.arange(b)
    ahead = np.arange(2 * b - 1)
    for lo in range(0, len(starts), at):
        some = starts[lo : lo + at, None]
        place = some + first + ahead
        # Codes are from 1 on, so what lies beyond the end equals no word.
        window = np.where(place < n, codes[np.minimum(place, n - 1)] % fold + np.uint64(1), np.uint64(0))
        sums = differences(codes[some + within] % fold + np.uint64(1), window)
        row, d = np.nonzero(sums == 0)
        yield some[row, 0], d + first


def _mismatch(codes: np.ndarray, at: int, d: int, step: int) -> int:
    """The first place from ``at`` on, forwards or backwards, whose word differs
    from the one d words further on (or has none)."""
    wide = 64
    end = len(codes) - d
    while 0 <= at < end:
        if step > 0:
            stop = min(at + wide, end)
            differ = codes[at:stop] != codes[at + d : stop + d]
            k = int(differ.argmax())
            if differ[k]:
                return at + k
            at = stop
        else:
            stop = max(at - wide, -1)
            differ = (codes[stop + 1 : at + 1] != codes[stop + 1 + d : at + 1 + d])[::-1]
            k = int(differ.argmax())
            if differ[k]:
                return at - k
            at = stop
        wide *= 4
    return at


class _Found:
    """Runs so far, and which of them reaches furthest over a place."""

    def __init__(self) -> None:
        self.runs: dict[tuple[int, int], int] = {}
        self.index()

    def index(self) -> None:
        rows = np.array([(s, e, q) for (s, e), q in sorted(self.runs.items())], dtype=np.int64).reshape(-1, 3)
        self.start = rows[:, 0]
        furthest = np.maximum.accumulate(rows[:, 1]) if len(rows) else rows[:, 1]
        best = np.where(rows[:, 1] == furthest, np.arange(len(rows)), 0)
        self.rows, self.best = rows, np.maximum.accumulate(best) if len(rows) else best

    def over(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End and period of the run that reaches furthest over each place, 0 and 1 where there is none."""
        if not len(self.start):
            return np.zeros(len(at), dtype=np.int64), np.ones(len(at), dtype=np.int64)
        k = np.searchsorted(self.start, at, side="right") - 1
        _, end, q = self.rows[self.best[np.maximum(k, 0)]].T
        return np.where(k >= 0, end, 0), q

    def multiples(self, at: np.ndarray, d: np.ndarray, b: int) -> np.ndarray:
        """Whether a block and its copy lie in a known run of which d is a multiple of the period."""
        end, q = self.over(at)
        return (at + d + b <= end) & (d % q == 0)

    def known(self, at: np.ndarray, b: int, reach: int) -> np.ndarray:
        """Whether a block lies with its windows in a known run and is no shorter than
        the period: a smallest period comes again at its multiples only."""
        end, q = self.over(at)
        return (at + reach <= end) & (q <= b)


def runs_of(codes: np.ndarray, offs: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """(start, end, period) of all runs of texts laid one after the other, by start
    and period.  ``codes`` are from 0 on and differ between texts; text i has the
    places ``offs[i]`` to ``offs[i + 1]``.  ``exponent`` is 4 or more."""
    if exponent < 4:
        raise ValueError("runs of fewer than four periods need not hold the blocks that seed them")
    n = len(codes)
    if n < least:
        return np.zeros((0, 3), dtype=np.int64)
    codes = codes.astype(np.uint64)
    order = np.argsort(codes, kind="stable")
    gap = np.full(n, n + 1, dtype=np.int64)  # to the next place of the same word
    again = codes[order[1:]] == codes[order[:-1]]
    gap[order[:-1][again]] = np.diff(order)[again]
    words = np.repeat(np.diff(offs), np.diff(offs))  # of the text that a place is in
    longest = int(np.diff(offs).max())
    found = _Found()
    furthest = gap.copy()  # the widest gap of each block of b words
    scale, b = 1, 1
    while exponent * scale <= longest:
        starts = np.arange(len(furthest)) * b
        if scale > b:
            starts = starts[:: scale // b]
        open_ = (furthest[starts // b] < 2 * scale) & (words[starts] >= exponent * scale)
        starts = starts[open_ & (starts + b <= n)]
        starts = starts[~found.known(starts, b, 2 * scale + b)]
        seeds: list[tuple[np.ndarray, np.ndarray]] = []
        for first in range(scale, 2 * scale, b):
            seeds += _occurrences(codes, starts, b, first)
        if seeds:
            at = np.concatenate([s for s, _ in seeds])
            d = np.concatenate([x for _, x in seeds])
            new = ~found.multiples(at, d, b)
            at, d = at[new], d[new]
            order = np.lexsort((at, d))
            at, d = at[order], d[order]
            # Chains of blocks that come again at one distance.
            head = np.ones(len(at), dtype=bool)
            head[1:] = (d[1:] != d[:-1]) | (at[1:] != at[:-1] + scale)
            first_of = np.flatnonzero(head)
            blocks = np.diff([*first_of, len(at)])
            wanted = (np.maximum(least, exponent * d[first_of]) - d[first_of] + 1) // scale - 1
            for k, count in zip(first_of[blocks >= wanted].tolist(), blocks[blocks >= wanted].tolist(), strict=True):
                q, reached = int(d[k]), -1
                # Blocks narrower than the scale leave gaps, over which a chain may be broken.
                for x in at[k : k + count].tolist():
                    if x < reached:
                        continue
                    start, reached = _mismatch(codes, x, q, -1) + 1, _mismatch(codes, x, q, 1)
                    end = reached + q
                    if end - start >= max(least, exponent * q):
                        # Of the periods of one stretch the smallest counts; the others are its multiples.
                        found.runs[start, end] = min(q, found.runs.get((start, end), q))
            found.index()
        scale *= 2
        if b < WIDEST:
            b *= 2
            whole = len(furthest) // 2 * 2
            rest = furthest[whole:]
            furthest = np.concatenate((np.maximum(furthest[0:whole:2], furthest[1:whole:2]), rest))
    rows = found.rows
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _word_codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A small number per word and text, and the place of each text's first word."""
    start, end, per = K.word_spans(data, offs)
    text_of = np.repeat(np.arange(len(offs) - 1, dtype=np.uint64), np.diff(per))
    hashes = K.mix(K.Spans(data)(start, end) + text_of * np.uint64(0xD6E8FEB86659FD93))
    _, codes = np.unique(hashes, return_inverse=True)
    return codes, per


RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def find_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """Add to each row ``n_words``, ``runs`` (start, length and period of every run,
    by start and period) and ``collapsed``: the words that no run holds after its
    first period, with one space between.

    Words are what ASCII white space divides, compared as they are.  A NULL or
    blank text has no words, no runs and the empty text as ``collapsed``.  Every
    row is worked on by itself, so repeated rows give repeated results; other
    columns stay, and columns of the new names are replaced.  An empty frame gives
    no rows.
    """
    added = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType()),
    ])
    rest = [c for c in docs.columns if c.lower() not in ("n_words", "runs", "collapsed")]
    docs = docs.select(*rest)
    text_at = next(i for i, c in enumerate(rest) if c.lower() == "text")
    arrow = pa.struct([pa.field(n, pa.int64(), False) for n in RUN.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in K.runs(batch.column(text_at)):
                codes, per = _word_codes(data, offs)
                found = runs_of(codes, per, least, exponent)
                mark = np.zeros(per[-1] + 1, dtype=np.int64)
                np.add.at(mark, found[:, 0] + found[:, 2], 1)
                np.add.at(mark, found[:, 1], -1)
                stays = np.cumsum(mark[:-1]) == 0
                raw = data.tobytes()
                texts = []
                for i in range(hi - lo):
                    words = raw[offs[i] : offs[i + 1]].split()
                    keep = stays[per[i] : per[i + 1]]
                    texts.append(b" ".join(words if keep.all() else [w for w, k in zip(words, keep, strict=True) if k]))
                cut = np.searchsorted(found[:, 0], per)
                base = per[np.searchsorted(per, found[:, 0], side="right") - 1]
                values = pa.StructArray.from_arrays(
                    [pa.array(found[:, 0] - base), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], fields=list(arrow)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(lo, hi - lo) for c in batch.columns], pa.array(np.diff(per).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), values), pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    [*batch.schema.names, *added.names],
                )

    return docs.transform(small_batches).mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def longest_run(runs: Column) -> Column:
    """The longest of ``runs``; of equals the one that starts first, then the one
    of the smallest period.  NULL if there is none."""
    ranked = F.transform(
        runs,
        lambda r: F.struct(
            r["length"].alias("length"), (-r["start"]).alias("early"), (-r["period"]).alias("short"), r.alias("run")
        ),
    )
    return F.array_max(ranked)["run"]


def with_repeated_tails(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of which about one in ten ends in a repetition, by the CRC-32 of the
    id, h: where 10 divides h and there are n > 0 words, each word from a = g % n on
    (g is h / 10) becomes the word at a + (i - a) % p, with
    p = 1 + (n - a) / (3 + g % 8).  Other texts, and rows of NULL id, stay."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    w, g, n, a, p = (free(docs, c) for c in ("_w", "_g", "_n", "_a", "_p"))
    h = id_crc(key)
    hit = F.col(key).isNotNull() & (h % 10 == 0)
    df = docs.withColumn(w, F.when(hit, words)).withColumn(g, F.floor(h / 10))
    df = df.withColumn(n, F.greatest(F.size(w), F.lit(0)))
    df = df.withColumn(a, F.when(F.col(n) > 0, F.col(g) % F.col(n)).cast("int"))
    df = df.withColumn(p, (F.lit(1) + F.floor((F.col(n) - F.col(a)) / (F.lit(3) + F.col(g) % 8))).cast("int"))
    left = F.col(n) - F.col(a)
    cycle = F.slice(w, F.col(a) + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(left / F.col(p)).cast("int"))), F.lit(1), left)
    text = F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")
    return df.withColumn("text", F.when(F.col(a).isNotNull(), text).otherwise(F.col("text"))).drop(w, g, n, a, p)
