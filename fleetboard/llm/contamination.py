"""Short test items inside long documents: size-partitioned MinHash containment
search, verified on whole shingle sets.

Items are parted by their number of shingles.  For a part whose items have at
most U shingles, a document is seen as blocks of U shingles, two neighbours at
a time, so any run of U shingles lies whole in one such window and an item's
containment there is a similarity MinHash can see.  The number of bands (of one
row each) follows from the wanted recall at the part's smallest similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import small_batches

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
LEAST = 8  # shingles of the smallest part; parts double from there
BLOCK_SHINGLES = 1_000_000  # shingles of the items that go to the tasks at once, 8 bytes each
_RNG = np.random.default_rng(4242)
_FLIP = _RNG.integers(0, 1 << 32, 512, dtype=np.uint64).astype(np.uint32)
_TURN = (_RNG.integers(0, 1 << 31, 512, dtype=np.uint64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)


def bands_for(part: int, threshold: float, recall: float) -> int:
    """Bands of one row that find an item of the part with the wanted recall: the
    smallest has half the part's bound, the window twice the bound."""
    found = threshold * part / 2
    similarity = found / (2 * part + part / 2 - found)
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity))


def part_of(n: int) -> int:
    return max(LEAST, 1 << (n - 1).bit_length())


@dataclass(frozen=True)
class Items:
    """A block of items: ids, distinct shingles, and the shingle length they use."""

    ids: list
    sets: list[np.ndarray]
    words: list[int]


def item_sets(items: DataFrame, words: int = WORDS) -> Iterator[Items]:
    """The items in blocks of bounded size, one block in the driver at a time.

    An item shorter than ``words`` is a single shingle of as many words as it
    has; NULL and empty items are contained in nothing and left out.
    """
    ids, sets, lengths, size = [], [], [], 0
    for row in items.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator(prefetchPartitions=False):
        lower = K.lower_text(pa.array([row["text"]]))
        for _, _, data, offs in K.runs(lower):
            n = min(words, len(K.word_spans(data, offs)[0]))
            if not n:
                continue
            found = np.unique(K.shingles(data, offs, n)[0])
            if ids and size + len(found) > BLOCK_SHINGLES:
                yield Items(ids, sets, lengths)
                ids, sets, lengths, size = [], [], [], 0
            ids.append(row["item_id"])
            sets.append(found)
            lengths.append(n)
            size += len(found)
    if ids:
        yield Items(ids, sets, lengths)


class Index:
    """Signatures of a block of items by shingle length and size part."""

    def __init__(self, items: Items, threshold: float, recall: float):
        self.items, self.threshold = items, threshold
        self.groups: dict[int, dict[int, list[int]]] = {}
        for i, (s, n) in enumerate(zip(items.sets, items.words, strict=True)):
            self.groups.setdefault(n, {}).setdefault(part_of(len(s)), []).append(i)
        self.bands = {p: bands_for(p, threshold, recall) for g in self.groups.values() for p in g}
        # Per length and part: for each band the items' minima, sorted, with the items.
        self.minima: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        for n, parts in self.groups.items():
            for p, members in parts.items():
                for k in range(self.bands[p]):
                    low = np.array([_hashed(items.sets[i], k).min() for i in members], dtype=np.uint32)
                    order = np.argsort(low, kind="stable")
                    self.minima[n, p, k] = low[order], np.array(members)[order]
        self.quick: dict[tuple[int, int, int], np.ndarray] = {}
        for key, (low, _) in self.minima.items():
            seen = np.zeros(1 << 16, dtype=bool)
            seen[low >> np.uint32(16)] = True
            self.quick[key] = seen

    def search(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) with the item's containment at the threshold."""
        found = []
        for n, parts in self.groups.items():
            hashes, per = K.shingles(data, offs, n)
            if not len(hashes):
                continue
            low32 = (hashes >> np.uint64(32)).astype(np.uint32)
            pairs: list[np.ndarray] = []
            # Blocks of LEAST shingles, that do not cross texts; larger parts join them.
            counts = np.diff(per)
            blocks = -(-counts // LEAST)
            first = np.cumsum(np.concatenate(([0], blocks)))
            starts = np.repeat(per[:-1], blocks) + LEAST * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
            for k in range(max(self.bands[p] for p in parts)):
                mins = np.minimum.reduceat((low32 ^ _FLIP[k]) * _TURN[k], starts)
                size, at = LEAST, first
                for p in sorted(parts):
                    while size < p:
                        mins, at = _double(mins, at)
                        size *= 2
                    if k >= self.bands[p]:
                        continue
                    hit = np.flatnonzero(self.quick[n, p, k][mins >> np.uint32(16)])
                    if len(hit):
                        low, members = self.minima[n, p, k]
                        lo, hi = np.searchsorted(low, mins[hit]), np.searchsorted(low, mins[hit], side="right")
                        for h, a, b in zip(hit[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                            text = int(np.searchsorted(at, h, side="right")) - 1
                            pairs.append(np.column_stack((np.full(b - a, text), members[a:b])))
            if pairs:
                found += self._verify(np.unique(np.concatenate(pairs), axis=0), hashes, per)
        return found

    def _verify(self, pairs: np.ndarray, hashes: np.ndarray, per: np.ndarray) -> list[tuple[int, int, int]]:
        out = []
        for text in np.unique(pairs[:, 0]):
            whole = np.unique(hashes[per[text] : per[text + 1]])
            for item in pairs[pairs[:, 0] == text, 1]:
                want = self.items.sets[item]
                at = np.minimum(np.searchsorted(whole, want), len(whole) - 1)
                shared = int((whole[at] == want).sum())
                if shared >= self.threshold * len(want):
                    out.append((int(text), int(item), shared))
        return out


def _hashed(hashes: np.ndarray, k: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)).astype(np.uint32) ^ _FLIP[k]) * _TURN[k]


def _double(mins: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima of pairs of neighbouring blocks of a text."""
    blocks = np.diff(at)
    half = -(-blocks // 2)
    first = np.cumsum(np.concatenate(([0], half)))
    left = np.repeat(at[:-1], half) + 2 * (np.arange(first[-1]) - np.repeat(first[:-1], half))
    last = np.repeat(at[1:], half) - 1
    return np.minimum(mins[left], mins[np.minimum(left + 1, last)]), first


def contained(
    docs: DataFrame, items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """(doc_id, item_id, shared, shingles, containment): items of which a document
    holds at least ``threshold`` of the distinct shingles.

    Nothing is shuffled: blocks of items of bounded size go to the tasks, one
    pass over the documents per block.  A repeated document or item row gives
    its rows again; an empty table on either side gives none.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, shared long, shingles long, containment double"
    out = None
    for block in item_sets(items, words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, threshold, recall)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                lower = K.lower_text(batch.column("text"))
                rows = [(ids[lo + t], i, n) for lo, _, d, o in K.runs(lower) for t, i, n in index.search(d, o)]
                items = index.items
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([items.ids[r[1]] for r in rows], pa.int64()),
                        pa.array([r[2] for r in rows], pa.int64()),
                        pa.array([len(items.sets[r[1]]) for r in rows], pa.int64()),
                        pa.array([r[2] / len(items.sets[r[1]]) for r in rows], pa.float64()),
                    ],
                    ["doc_id", "item_id", "shared", "shingles", "containment"],
                )

        part = docs.select(F.col("doc_id").cast("long"), "text").transform(small_batches).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all columns, that contain no item."""
    for block in item_sets(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, THRESHOLD, RECALL)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for lo, _, d, o in K.runs(K.lower_text(batch.column("text"))):
                    keep[[lo + t for t, _, _ in index.search(d, o)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.transform(small_batches).mapInArrow(run, docs.schema)
    return docs
