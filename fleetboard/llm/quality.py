"""Quality by histogram gradient-boosted trees over statistics of a document.

Trees are complete and flattened into arrays: a level of all trees is one numpy
step over all documents of a batch.  The trees are grown from histograms of
binned statistics, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded_sample, small_batches

SAMPLE = 20_000  # labelled rows that a model is fitted on at most
STATS = (
    "bytes", "words", "word_bytes", "upper", "digits", "punctuation", "symbols", "bars", "exclaims",
    "spaces", "lines", "line_bytes", "distinct_words", "repeated_words", "beyond_ascii", "symbol_words",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_PUNCT = _class(".,;:?'\"()-")
_SYMBOL = _class("#$%&*@<>{}[]\\^~=_+/`")


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of ``STATS`` per text; an empty text has zeros."""
    n = len(offs) - 1
    size = np.diff(offs)

    def count(mask: np.ndarray, at: np.ndarray = offs) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, dtype=np.int64)
        np.cumsum(mask, out=sums[1:])
        return np.diff(sums[at])

    start, end, per = K.word_spans(data, offs)
    words = np.diff(per)
    hashes = K.Spans(data)(start, end)
    text_of = np.repeat(np.arange(n, dtype=np.uint64), words)
    distinct = np.unique((text_of << np.uint64(42)) | (hashes >> np.uint64(22)))
    n_distinct = np.bincount((distinct >> np.uint64(42)).astype(np.int64), minlength=n)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1])
    symbol = _SYMBOL[data]
    sums = np.concatenate(([0], np.cumsum(symbol, dtype=np.int64)))
    letters = np.concatenate(([0], np.cumsum(end - start)))
    lines = count(data == 10) + (size > 0)
    by, w = np.maximum(size, 1), np.maximum(words, 1)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.diff(letters[per]) / w,
        count(_UPPER[data]) / by, count(_DIGIT[data]) / by, count(_PUNCT[data]) / by, count(symbol) / by,
        count(data == 124) / by, count(data == 33) / by, count(K.SPACE[data]) / by, lines / by,
        np.log1p(size / np.maximum(lines, 1)), n_distinct / w, count(again, per) / w,
        count(data > 127) / by, count(sums[end] > sums[start], per) / w,
    ])


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: per tree and inner node a statistic and a
    threshold, per leaf a value; ``base`` is the score before any tree."""

    base: float
    stat: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.leaf):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        depth = self.leaf.shape[1].bit_length() - 1
        trees = np.arange(len(self.leaf))
        node = np.zeros((len(x), len(trees)), dtype=np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(depth):
            right = x[rows, self.stat[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        total = self.base + self.leaf[trees, node - (2**depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2) -> Trees:
    """Boost logistic loss.  One class only, or no row, gives a constant."""
    n, stats = x.shape if len(x) else (0, len(STATS))
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if not n or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(stats)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    total = np.full(n, base)
    out_stat, out_thr, out_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        stat, thr = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            here = 2**level
            local = node - (here - 1)
            best = np.full(here, 1e-9)
            cut_bin = np.full(here, bins)
            for f in range(stats):
                key = local * bins + binned[:, f]
                g = np.bincount(key, grad, here * bins).reshape(here, bins).cumsum(axis=1)
                h = np.bincount(key, hess, here * bins).reshape(here, bins).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                gain[(h < 1) | (ht - h < 1)] = 0
                at = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(here), at] > best):
                    if at[k] < len(edges[f]):
                        best[k] = gain[k, at[k]]
                        stat[here - 1 + k], thr[here - 1 + k], cut_bin[k] = f, edges[f][at[k]], at[k]
            right = binned[np.arange(n), stat[node]] > cut_bin[local]
            node = 2 * node + 1 + right
        leaf_of = node - inner
        g = np.bincount(leaf_of, grad, inner + 1)
        h = np.bincount(leaf_of, hess, inner + 1)
        leaf = rate * g / (h + 1)
        total += leaf[leaf_of]
        out_stat.append(stat)
        out_thr.append(thr)
        out_leaf.append(leaf)
    return Trees(base, np.array(out_stat), np.array(out_thr), np.array(out_leaf))


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int = SAMPLE) -> Trees:
    """Fit on labelled rows for which ``learn`` holds, ``sample`` of them at most.

    Their statistics, a few numbers each, are all that reaches the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn)
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("_y"))
    some = bounded_sample(known, "doc_id", sample)  # 16 bytes a row: under a megabyte by ``sample``
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(d, o) for _, _, d, o in K.runs(batch.column("text"))]
            if found:
                x = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), pa.list_(pa.float64())), batch.column("_y")], ["x", "y"]
                )

    rows = texts.transform(small_batches).mapInArrow(run, "x array<double>, y double").toPandas()
    order = np.lexsort(np.array([*np.array(rows["x"].tolist()).T, rows["y"]])) if len(rows) else []
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), -1)[order] if len(rows) else np.zeros((0, len(STATS)))
    return fit(x, rows["y"].to_numpy(dtype=float)[order] if len(rows) else np.zeros(0))


def score(docs: DataFrame, model: Trees, out: str = "score") -> DataFrame:
    """(doc_id, score) for every whole text; NULL counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(statistics(d, o)) for _, _, d, o in K.runs(batch.column("text"))]
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", out])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(small_batches).mapInArrow(run, f"doc_id long, {out} double")
