"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A run of three letters is bound
into one vector: the letters' vectors, rotated by their place, multiplied.  The
vectors of a text's runs are bundled by addition, as are the texts of a
language into its prototype, and a text goes to the prototype of the largest
cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import bounded_sample, small_batches

DIM = 512
CODES = 1 << 14  # letters share a vector only if they are this many apart by hash
SAMPLE = 20_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point its letter code, 0 for what is not a letter."""
    codes = np.zeros(0x110000, dtype=np.uint16)
    points = np.array([c for c in range(0x110000) if chr(c).isalpha()])
    low = points < CODES
    codes[points[low]] = points[low]
    codes[points[~low]] = 1 + K.mix(points[~low].astype(np.uint64)) % np.uint64(CODES - 1)
    return codes


@lru_cache(maxsize=2)
def _vectors(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors at the three places of a run; a rotation is one step."""
    bits = np.random.default_rng(31337).integers(0, 2, (CODES, dim), dtype=np.int8)
    base = bits * np.int8(2) - np.int8(1)
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def runs_of_three(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, packed letters, count) of the distinct runs, by text; what lies
    between words counts as one letter of its own, also at both ends."""
    lower = [t.lower() for t in texts]
    size = np.fromiter(map(len, lower), dtype=np.int64, count=len(lower))
    raw = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = _letters()[raw]
    text_of = np.repeat(np.arange(len(texts), dtype=np.uint64), size)
    # Of each run of other characters the first stays.
    first = np.ones(len(code), dtype=bool)
    first[1:] = text_of[1:] != text_of[:-1]
    keep = (code > 0) | first
    keep[1:] |= code[:-1] > 0
    code, text_of = code[keep].astype(np.uint64), text_of[keep]
    # Pad each text by a gap at both ends.
    n = np.bincount(text_of.astype(np.int64), minlength=len(texts))
    padded = np.zeros(len(code) + 2 * len(texts), dtype=np.uint64)
    padded[np.arange(len(code)) + 2 * text_of.astype(np.int64) + 1] = code
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), n + 2)
    three = (padded[:-2] << np.uint64(28)) | (padded[1:-1] << np.uint64(14)) | padded[2:]
    inside = (owner[:-2] == owner[2:]) & ~((padded[1:-1] == 0) & ((padded[:-2] == 0) | (padded[2:] == 0)))
    key = np.sort((owner[:-2][inside] << np.uint64(42)) | three[inside])
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(key)))
    key = key[starts]
    return (key >> np.uint64(42)).astype(np.int64), key & np.uint64((1 << 42) - 1), count


def bundle(texts: list[str], dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text and whether it has a letter at all."""
    owner, three, count = runs_of_three(texts)
    out = np.zeros((len(texts), dim), dtype=np.float32)
    if not len(owner):
        return out, np.zeros(len(texts), dtype=bool)
    distinct, at = np.unique(three, return_inverse=True)
    low = np.uint64(CODES - 1)
    a, b, c = _vectors(dim)
    bound = (
        a[(distinct >> np.uint64(28)).astype(np.int64)]
        * b[((distinct >> np.uint64(14)) & low).astype(np.int64)]
        * c[(distinct & low).astype(np.int64)]
    ).astype(np.float32)
    edge = np.searchsorted(owner, np.arange(len(texts) + 1))
    weight = count.astype(np.float32)
    for t in range(len(texts)):
        lo, hi = edge[t], edge[t + 1]
        for s in range(lo, hi, 4096):
            e = min(hi, s + 4096)
            out[t] += weight[s:e] @ bound[at[s:e]]
    return out, edge[1:] > edge[:-1]


def _text_runs(column: pa.Array) -> Iterator[list[str]]:
    for lo, hi, _, _ in K.runs(column, 1 << 20):
        yield [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


@dataclass(frozen=True)
class Prototypes:
    names: tuple[str, ...]
    unit: np.ndarray  # one row of length 1 per language

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        vec, lettered = bundle(texts, self.unit.shape[1])
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        norm = np.sqrt((vec.astype(np.float64) ** 2).sum(axis=1))
        cosine = vec @ self.unit.T / np.maximum(norm, 1e-9)[:, None]
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1) * lettered
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], score


def train(docs: DataFrame, learn: Column, lang: str = "lang", sample: int = SAMPLE, dim: int = DIM) -> Prototypes:
    """Prototypes from rows with a language for which ``learn`` holds, about
    ``sample`` of them at most.  Texts weigh alike.  Each task sends one sum per
    language it met; the driver gets ``dim`` numbers a language."""
    known = docs.where(F.col(lang).isNotNull() & learn).select("doc_id", F.col(lang).alias("_lang"), "text")
    some = bounded_sample(known, "doc_id", sample).select("_lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, at = batch.column("_lang").to_pylist(), 0
            for texts in _text_runs(batch.column("text")):
                vec, _ = bundle(texts, dim)
                # Whole numbers, so that the order of addition cannot matter.
                norm = np.sqrt((vec.astype(np.float64) ** 2).sum(axis=1))
                unit = np.rint(vec / np.maximum(norm, 1e-9)[:, None] * (1 << 20)).astype(np.int64)
                for i in range(len(texts)):
                    name = langs[at + i]
                    sums[name] = sums.get(name, 0) + unit[i]
                at += len(texts)
        for name, total in sums.items():
            yield pa.RecordBatch.from_pydict(
                {"lang": [name] * dim, "place": np.arange(dim), "value": total},
                schema=pa.schema([("lang", pa.string()), ("place", pa.int64()), ("value", pa.int64())]),
            )

    sums = some.transform(small_batches).mapInArrow(run, "lang string, place long, value long").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = sums.toPandas()
    names = tuple(sorted(rows["lang"].unique()))
    table = np.zeros((len(names), dim))
    place = {n: i for i, n in enumerate(names)}
    table[[place[n] for n in rows["lang"]], rows["place"].to_numpy(dtype=int)] = rows["value"].to_numpy(dtype=float)
    norm = np.sqrt((table**2).sum(axis=1, keepdims=True))
    return Prototypes(names, (table / np.maximum(norm, 1e-9)).astype(np.float32))


def identify(docs: DataFrame, model: Prototypes) -> DataFrame:
    """(doc_id, lang_pred, score): the prototype of the largest cosine, and that
    cosine, 0 if negative.  A NULL text or one without a letter is ``und`` with
    score 0; of equal cosines the first language by name wins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            scores: list[np.ndarray] = []
            for texts in _text_runs(batch.column("text")):
                n, s = model.predict(texts)
                names += n
                scores.append(s)
            if scores:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.concatenate(scores).astype(float))],
                    ["doc_id", "lang_pred", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").transform(small_batches).mapInArrow(run, "doc_id long, lang_pred string, score double")
