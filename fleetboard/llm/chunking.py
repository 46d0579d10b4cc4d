"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes decides where a text is cut.  Cuts are
normalised: before the normal size a cut needs more zero bits than after it, so
sizes crowd round the normal one.  A fingerprint is the set of chunk digests,
each with its length; what two of them share, weighed by length, measures how
much of one text is in the other.  Since cuts depend on nearby bytes only, text
put in or taken out moves few of them.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import small_batches

MIN, NORMAL, MAX = 8, 32, 128  # bytes
HARD, EASY = 6, 4  # zero bits asked for before and after the normal size
_WINDOW = 16  # the bits of the hash: a byte has left it after so many shifts
_GEAR = (K.BYTE_CODES >> np.uint64(48)).astype(np.uint16)


def _gear(data: np.ndarray) -> np.ndarray:
    """The hash at every byte: sum of code(b[i-k]) << k for k below 16."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        if len(h) > step:
            shifted = h[:-step] << np.uint16(step)
            h = np.concatenate((h[:step], h[step:] + shifted))
    return h


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk starts, ends, and each text's first chunk.  Cuts fall between code
    points.  The hash at a text's first bytes also covers the text before it,
    so those places are hashed again on their own."""
    h = _gear(data)
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        if a and b > a:
            h[a : min(a + _WINDOW, b)] = _gear(data[a : min(a + _WINDOW, b)])
    whole = np.ones(len(data) + 1, dtype=bool)  # a code point begins here
    whole[:-1] = (data & 0xC0) != 0x80
    top = h >> np.uint16(_WINDOW - EASY)
    easy = np.flatnonzero((top == 0) & whole[1:]) + 1
    hard = easy[(h[easy - 1] >> np.uint16(_WINDOW - HARD)) == 0].tolist()
    easy = easy.tolist()
    start, end, first = [], [], [0]
    n_hard, n_easy = len(hard), len(easy)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        while a < b:
            cut = min(b, a + MAX)
            i = bisect_left(hard, a + MIN)
            if i < n_hard and hard[i] < a + NORMAL and hard[i] < cut:
                cut = hard[i]
            else:
                i = bisect_left(easy, a + NORMAL)
                if i < n_easy and easy[i] < cut:
                    cut = easy[i]
                elif cut < b:
                    while not whole[cut]:
                        cut -= 1
            start.append(a)
            end.append(cut)
            a = cut
        first.append(len(start))
    return np.array(start, np.int64), np.array(end, np.int64), np.array(first, np.int64)


def fingerprints(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Per text its set of chunks: 56 bits of digest over eight of length, sorted."""
    start, end, first = chunks(data, offs)
    size = (end - start).astype(np.uint64)
    packed = (K.Spans(data)(start, end) & ~np.uint64(255)) | size
    return [np.unique(packed[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the length of ``a`` whose chunks ``b`` has too; equal sets give 1."""
    if not len(a):
        return float(not len(b))
    if not len(b):
        return 0.0
    size = (a & np.uint64(255)).astype(np.int64)
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return float(size[b[at] == a].sum() / size.sum())


def as_string(fp: np.ndarray) -> str:
    return base64.b64encode(fp.astype("<u8").tobytes()).decode()


def from_string(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype="<u8")


def _prints(texts: list[str]) -> list[np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    return fingerprints(np.frombuffer(b"".join(raw), dtype=np.uint8), offs)


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of ``text`` as a string; NULL counts as empty, and an
    empty text has the empty fingerprint.  A column named ``out`` is replaced."""
    df = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str] = []
            for _, _, data, offs in K.runs(batch.column(text)):
                found += map(as_string, fingerprints(data, offs))
            columns = [*batch.columns, pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    return df.transform(small_batches).mapInArrow(run, schema)


def with_next(df: DataFrame, buckets: int) -> DataFrame:
    """Rows (doc_id, text, extra) so placed and sorted that the next document by
    descending id is the next row of the partition.

    The ids' quantiles cut the table into ``buckets`` ranges.  The one row that
    follows a range, found by a small aggregate, is sent to that range too, as
    ``extra``; so texts are shuffled once.  Only the cuts and the first id of
    each range reach the driver.  NULL ids come last; rows of one id are ordered
    by a hash of their text.
    """
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    cuts = rows.agg(
        F.percentile_approx(F.col("doc_id").cast("double"), [i / buckets for i in range(1, buckets)], 10_000)
    ).first()[0]
    splits = [-float("inf"), *sorted(set(cuts or [])), float("inf")]
    rows = rows.withColumn("_d", F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf"))))
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="_d", outputCol="_b").transform(rows)
    else:
        rows = rows.withColumn("_b", F.lit(0.0))
    rows = rows.withColumn("_b", (len(splits) - 2 - F.col("_b")).cast("int")).drop("_d")
    heads = rows.groupBy("_b").agg(F.max(F.struct("doc_id", "_h")).alias("top")).orderBy("_b").collect()
    # At most one row per bucket.
    before = [(heads[i - 1]["_b"], h["top"]["doc_id"], h["top"]["_h"]) for i, h in enumerate(heads)]
    schema = T.StructType([
        T.StructField("_to", T.IntegerType()),
        T.StructField("_id", df.schema["doc_id"].dataType),
        T.StructField("_hh", T.LongType()),
    ])
    ends = df.sparkSession.createDataFrame(before, schema)
    rows = rows.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hh")), "left")
    here = F.struct(F.col("_b").alias("b"), F.lit(0).alias("extra"))
    there = F.struct(F.col("_to").alias("b"), F.lit(1).alias("extra"))
    places = F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, there))
    rows = rows.select("doc_id", "text", "_h", F.explode(places).alias("_p"))
    rows = rows.select("doc_id", "text", "_h", F.col("_p.b").alias("_b"), F.col("_p.extra").alias("extra"))
    placed = rows.repartitionById(max(1, len(splits) - 1), "_b")
    return placed.sortWithinPartitions(
        "_b", "extra", F.col("doc_id").desc_nulls_last(), F.col("_h").desc()
    ).select("doc_id", "text", "extra")


COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all but the last of the texts, each against the one after it."""
    edited = []
    for a, b in zip(texts[:-1], texts[1:], strict=True):
        half = len(a) // 2
        edited.append(a[: len(a) - half] + b[:half])
    own, new = _prints(texts), _prints(edited)
    sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:-1], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array(sha, pa.string()),
            pa.array([as_string(x) for x in own[:-1]], pa.string()),
            pa.array([as_string(x) for x in new], pa.string()),
            pa.array([containment(a, b) for a, b in zip(own, new, strict=False)], pa.float64()),
            pa.array([containment(a, b) for a, b in zip(own[:-1], own[1:], strict=True)], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def compare_with_next(df: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited form: the last half (rounded down) of
    its code points replaced by as many from the start of the next document.

    ``near_*`` is the containment of the text's fingerprint in the other one, in
    0 to 1; two empty texts give 1.  A single document is followed by itself;
    repeated rows each give a row; an empty frame gives none.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, ended = 0, False
        for batch in batches:
            for i, t, extra in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if ended:
                    continue
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                ended = bool(extra)
                if size > K.RUN_BYTES and len(ids) > 1:
                    yield _compare(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]
                    size = len(texts[0])
        if len(ids) > 1:
            yield _compare(ids, texts)

    return with_next(df, buckets).transform(small_batches).mapInArrow(run, COMPARED)
