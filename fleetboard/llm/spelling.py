"""Spelling variants by neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols, so a word becomes a reduced word, and many
words share one.  Words within one edit have reduced words within one edit.
Every distinct reduced word gives its one-edit neighbourhood over the small
alphabet as hashed keys: itself, each symbol replaced, each symbol left out; an
inserted symbol is the other word's left-out one, and of two replaced symbols
the greater is tried, so two reduced words meet once.  The keys are joined with
the reduced vocabulary, and the words behind a match are verified letter by letter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import small_batches, stored

WORD = "[A-Za-zÀ-ÿ]"  # a letter of a word
LEAST = 7  # letters of a word that counts
SEEN = 2  # occurrences of a word that counts
TIMES = 10  # a form is at least so many times as frequent
SYMBOLS = 8
HELD = 100_000  # counted words that a task holds at once
KEYS = 400_000  # keys that a task makes at once
_ASCII = {c: c + 32 for c in range(65, 91)}
_VALUE = K.mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SIZE = np.uint64(0xC2B2AE3D27D4EB4F)


def lower_ascii(word: str) -> str:
    return word.lower() if word.isascii() else word.translate(_ASCII)


def count_words(docs: DataFrame, key: str = "doc_id", slip: int | None = None, least: int = LEAST) -> DataFrame:
    """(word, n): how often each word of ``least`` letters or more occurs, with A to Z
    in lower case.  With ``slip``, words lose a letter now and then: where ``slip``
    divides the CRC-32 of ``<key>:<word>``, the letter at that number modulo the
    word's length goes.  A NULL text has no words; a NULL key is written as nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(f"{WORD}{{{least},}}").findall
        counts: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.string())
            rows = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return rows

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{name or ''}:".encode())
                for word, n in Counter(find(text)).items():
                    word = lower_ascii(word)
                    if slip:
                        h = zlib.crc32(word.encode(), start)
                        if not h % slip:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < least:
                                continue
                    counts[word] += n
                if len(counts) > HELD:
                    yield handed()
        yield handed()

    rows = docs.select(F.col(key).cast("string"), F.col("text"))
    return rows.transform(small_batches).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Reduced:
    """Words laid one after the other as reduced words, with hashes of any part."""

    def __init__(self, words: list[str]):
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        self.symbol = (K.mix(points + np.uint64(1)) >> np.uint64(32)).astype(np.int64) % SYMBOLS
        n = len(points)
        self.fore, self.back = K._powers(max(n, 1).bit_length())
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[self.symbol] * self.fore[:n], out=self.sums[1:])
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size

    def _key(self, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        return K.mix(raw + size.astype(np.uint64) * _SIZE).view(np.int64)

    def own(self) -> np.ndarray:
        return self._key((self.sums[self.end] - self.sums[self.start]) * self.back[self.start], self.size)

    def neighbours(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, key) of the neighbourhood made at the letters lo to hi."""
        place = np.arange(lo, hi)
        word = np.searchsorted(self.end, place, side="right")
        start, end, size = self.start[word], self.end[word], self.size[word]
        whole = (self.sums[end] - self.sums[start]) * self.back[start]
        words, keys = [], []
        for s in range(1, SYMBOLS):
            at = self.symbol[lo:hi] < s
            old = self.symbol[lo:hi][at]
            raw = whole[at] + (_VALUE[s] - _VALUE[old]) * self.fore[place[at] - start[at]]
            words.append(word[at])
            keys.append(self._key(raw, size[at]))
        # Of equal symbols next to each other any one may go, with the same result.
        at = place == start
        if len(place):
            before = self.symbol[np.maximum(place - 1, 0)]
            at |= before != self.symbol[lo:hi]
        p, a, e = place[at], start[at], end[at]
        raw = (self.sums[p] - self.sums[a]) * self.back[a] + (self.sums[e] - self.sums[p + 1]) * self.back[a + 1]
        words.append(word[at])
        keys.append(self._key(raw, size[at] - 1))
        return np.concatenate(words), np.concatenate(keys)


def _with_reduced(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = _Reduced(batch.column(0).to_pylist()).own() if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], ["word", "n", "_r"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, _r long")


def _neighbourhoods(reduced: DataFrame) -> DataFrame:
    """(_key, _r): the keys of the neighbourhood of every reduced word, given by one
    of its words.  Keys are made letter by letter, so long words need no more memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = KEYS // SYMBOLS
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _Reduced(batch.column(1).to_pylist())
            own = batch.column(0).to_numpy()
            for lo in range(0, int(words.end[-1]), step):
                of, keys = words.neighbours(lo, min(lo + step, int(words.end[-1])))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[of])], ["_key", "_r"])

    parts = int(reduced.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reduced.select("_r", "_word").repartition(parts, "_r").mapInArrow(run, "_key long, _r long")


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two words that differ by exactly one inserted, deleted
    or replaced code point, once.  ``words`` has distinct, non-empty ``word`` and ``n``."""
    reduced = stored(_with_reduced(words), "reduced_words")
    one = reduced.groupBy("_r").agg(F.min("word").alias("_word"), F.count(F.lit(1)).alias("_c"))
    one = stored(one, "reduced_vocabulary")
    left = reduced.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("_r").alias("_a"))
    right = reduced.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("_r").alias("_b"))
    met = _neighbourhoods(one).join(right, F.col("_key") == F.col("_b")).select("_r", "b", "b_n")
    found = met.join(left, F.col("_r") == F.col("_a"))
    shared = left.join(one.where("_c > 1").select("_r"), F.col("_a") == F.col("_r"), "left_semi")
    same = shared.join(right, (F.col("_a") == F.col("_b")) & (F.col("a") < F.col("b")))
    pairs = found.select("a", "a_n", "b", "b_n").unionByName(same.select("a", "a_n", "b", "b_n"))
    return pairs.where(F.levenshtein("a", "b", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word on the way from ``word`` by ``form`` to ``form``.

    Ways are halved in every round; a way has no circle, as forms are ever more
    frequent, and no more steps than the greatest count has digits.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        met = now.join(on, F.col("root") == F.col("_at"), "left")
        moved = stored(met.select("word", F.coalesce("_next", "root").alias("root"), F.col("_at").isNotNull().alias("_moved")), "forms")
        if not moved.where("_moved").limit(1).count():
            return moved.drop("_moved")
        now = moved.drop("_moved")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each of ``words`` (word, n).

    ``n_near`` counts the words at one edit.  ``form`` is the most frequent of them,
    of equals the first in code-point order, if it is at least ``times`` as frequent;
    else it is NULL, as ``form_n``.  ``root`` follows forms to the last; a word
    without a form is its own root.  No words give no rows.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = stored(near_words(words), "near_words")
    both = pairs.select("a", "b", "b_n").union(pairs.select("b", "a", "a_n")).toDF("_w", "_o", "_on")
    best = both.groupBy("_w").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_on")).alias("m"), "_o")).alias("_best"))
    chosen = F.when(-F.col("_best.m") >= times * F.col("n"), F.col("_best"))
    found = words.join(best, F.col("word") == F.col("_w"), "left").select(
        "word", chosen["_o"].alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-chosen["m"]).alias("form_n")
    )
    found = stored(found, "word_forms")
    last = roots(found.where("form is not null")).toDF("_w", "root")
    return found.join(last, F.col("word") == F.col("_w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def group_variants(docs: DataFrame, key: str = "doc_id", slip: int | None = None) -> DataFrame:
    """:func:`variants` of the words of all documents that occur ``SEEN`` times or more.

    Rows that come twice count twice; NULL and empty texts have no words.
    """
    return variants(count_words(docs, key, slip).where(F.col("n") >= SEEN))
