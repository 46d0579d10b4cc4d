"""N-gram Jaccard join of whole documents by MinHash banding.

Equal texts are one class.  Each class has a signature of bands, whose number
and rows follow from the wanted recall at the threshold; classes meet on band
hashes, and what met in a band is verified on the full shingle sets.  Verifying
goes by blocks of texts of bounded size: the texts that a text met name the
smallest of them, texts of one such name are one block (or several, dealt by
hash), and two blocks are a task if a bucket holds texts of both.  So a bucket never makes pairs, false candidates tie no clusters
together, and a task gives a row per text, not per pair.  Only ids are shuffled
until then; of the documents only those that met another are read again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import free, small_batches, stored
from .graph import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 192
BLOCK_TEXTS = 256
BLOCK_SHINGLES = 400_000
MEMBER_BYTES = 100  # of a row of ids in a broadcast table
BROADCAST_BYTES = 16 << 20
_RNG = np.random.default_rng(977)
_FLIP = _RNG.integers(0, 1 << 32, 1024, dtype=np.uint64).astype(np.uint32)
_TURN = (_RNG.integers(0, 1 << 31, 1024, dtype=np.uint64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)


def banding(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which bands enough for the recall at the
    threshold fit into ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("more hashes are needed for this recall")
    return best


def band_hashes(hashes: np.ndarray, per: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row of band hashes for each text that has a shingle."""
    starts = per[:-1][np.diff(per) > 0]
    out = np.zeros((len(starts), bands), dtype=np.uint64)
    if not len(starts):
        return out
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    for b in range(bands):
        h = np.full(len(starts), b + 1, dtype=np.uint64)
        for r in range(b * rows, (b + 1) * rows):
            least = np.minimum.reduceat((low ^ _FLIP[r]) * _TURN[r], starts)
            h = (h ^ least) * np.uint64(0x9E3779B97F4A7C15)
        out[:, b] = K.mix(h)
    return out


SIGNED = "_doc long, _th long, _id binary, _n long, _bands array<long>"


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2)
            lower = K.lower_text(text)
            for lo, hi, data, offs in K.runs(lower):
                hashes, per = K.shingles(data, offs, words)
                sizes = np.diff(per)
                sig = band_hashes(hashes, per, bands, rows)
                ends = np.cumsum(np.concatenate(([0], np.where(sizes > 0, bands, 0)))).astype(np.int32)
                ids = [
                    xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass"))
                    for t in text.slice(lo, hi - lo).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                        pa.array(ids, pa.binary()), pa.array(sizes.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.reshape(-1).view(np.int64))),
                    ],
                    ["_doc", "_th", "_id", "_n", "_bands"],
                )

    return docs.transform(small_batches).mapInArrow(run, SIGNED)


def _verify(threshold: float):
    """Links among the texts of one block or between those of two."""

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("_id")
        ids = table.column("_id").to_pylist()
        block = table.column("_b").to_numpy()
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        sets = table.column("_set").combine_chunks()
        offs = sets.offsets.to_numpy() - sets.offsets[0].as_py()
        distinct, at = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        n, size = len(ids), np.diff(offs)
        links = np.zeros((n, n), dtype=bool)
        mark = np.zeros(len(distinct), dtype=bool)
        for x in range(n):
            if i != j and block[x] != i:
                continue
            own = at[offs[x] : offs[x + 1]]
            mark[own] = True
            shared = np.add.reduceat(mark[at], offs[:-1], dtype=np.int64)
            mark[own] = False
            links[x] = shared / (size + size[x] - shared) >= threshold
        links &= ~np.eye(n, dtype=bool)
        if i != j:
            links &= block[:, None] != block[None, :]
            links |= links.T
        label = np.arange(n)
        while True:
            low = np.minimum(label, np.where(links, label[None, :], n).min(axis=1))
            low = low[low]
            if (low == label).all():
                break
            label = low
        linked = np.flatnonzero(links.any(axis=1))
        return pa.table(
            {
                "_id": pa.array([ids[k] for k in linked], pa.binary()),
                "_links": pa.array(links.sum(axis=1)[linked].astype(np.int64)),
                "_root": pa.array([ids[label[k]] for k in linked], pa.binary()),
            }
        )

    return verify


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """Add the distinct shingles of ``_text`` in place of it."""
    fields = [f for f in texts.schema.fields if f.name != "_text"]
    out = T.StructType([*fields, T.StructField("_set", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for _, _, data, offs in K.runs(K.lower_text(batch.column("_text"))):
                hashes, per = K.shingles(data, offs, words)
                sets += [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(per[:-1], per[1:], strict=True)]
            columns = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.list_(pa.int64()))], out.names)

    return texts.transform(small_batches).mapInArrow(run, out)


class Joined:
    """What a join found: ``rows`` (document, text hash, class key) and ``classes``
    (class key, its first document, its number of documents, links, group key)."""

    def __init__(self, rows: DataFrame, classes: DataFrame):
        self.rows, self.classes = rows, classes


def _meetings(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members, the classes that met another in a band, with their block; and the
    tasks (_i, _j, _id, _b): the members of every two blocks that share a bucket."""
    keyed = classes.select("_id", F.explode("_bands").alias("_band"))
    buckets = keyed.groupBy("_band").agg(F.min("_id").alias("_low"), F.count(F.lit(1)).alias("_c")).where("_c > 1")
    met = stored(keyed.join(buckets.select("_band", "_low"), "_band"), "meetings")
    homes = met.groupBy("_id").agg(F.min("_low").alias("_home"))
    homes = stored(homes.join(classes.select("_id", "_first", "_n"), "_id"), "homes")
    # Blocks of a home by its number of texts and of shingles, whichever asks for more.
    blocks = F.greatest(F.sum("_n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_TEXTS)
    cut = homes.groupBy("_home").agg(F.ceil(blocks).cast("int").alias("_blocks"))
    dealt = F.pmod(F.xxhash64("_id", F.lit(5)), F.col("_blocks"))
    members = homes.join(cut, "_home").select(
        "_id", F.col("_first._doc").alias("_d"), F.col("_first._th").alias("_t"), F.xxhash64("_home", dealt).alias("_b")
    )
    members = stored(members, "members")
    # Blocks that share a bucket, then the texts of both: no row of a text per bucket.
    beside = met.join(members.select("_id", "_b"), "_id").select("_band", "_b").distinct()
    other = beside.select("_band", F.col("_b").alias("_o"))
    pairs = beside.join(other, "_band").where("_b <= _o").select(F.col("_b").alias("_i"), F.col("_o").alias("_j")).distinct()
    sides = pairs.select("_i", "_j", F.explode(F.array_distinct(F.array("_i", "_j"))).alias("_b"))
    return members, sides.join(members.select("_id", "_b"), "_b").select("_i", "_j", "_id", "_b")


def _texts_of(slim: DataFrame, members: DataFrame) -> DataFrame:
    """(_id, _text) of the members.  Their ids are broadcast if they are measured to
    take up to ``BROADCAST_BYTES``; beyond that documents are shuffled by id."""
    small = members.count() * MEMBER_BYTES <= BROADCAST_BYTES
    right = members.select("_id", "_d", "_t")
    right = F.broadcast(right) if small else right
    found = slim.join(right, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")))
    return found.select("_id", "_text")


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> Joined:
    bands, rows = banding(threshold, recall)
    slim = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_th"), F.col("text").alias("_text"))
    signed = stored(signatures(slim, words, bands, rows), "signatures")
    first = F.min(F.struct(F.col("_doc").isNull().alias("none"), "_doc", "_th"))
    classes = stored(
        signed.groupBy("_id").agg(
            first.alias("_first"), F.count(F.lit(1)).alias("_copies"), F.first("_n").alias("_n"), F.first("_bands").alias("_bands")
        ),
        "classes",
    )
    members, tasks = _meetings(classes)
    # A document row that comes twice gives its class once.
    sets = stored(_shingle_sets(_texts_of(slim, members), words).dropDuplicates(["_id"]), "sets")
    found = tasks.join(sets, "_id").groupBy("_i", "_j").applyInArrow(_verify(threshold), "_id binary, _links long, _root binary")
    found = stored(found, "links")
    group = components(found.select(F.col("_id").alias("a"), F.col("_root").alias("b")))
    links = found.groupBy("_id").agg(F.sum("_links").alias("_links"))
    out = (
        classes.select("_id", "_first", "_copies")
        .join(links, "_id", "left")
        .join(group.select(F.col("a").alias("_id"), F.col("b").alias("_group")), "_id", "left")
        .withColumns({"_links": F.coalesce("_links", F.lit(0)), "_group": F.coalesce("_group", "_id")})
    )
    heads = out.groupBy("_group").agg(F.min("_first").alias("_head"))
    return Joined(signed.select("_doc", "_th", "_id"), stored(out.join(heads, "_group"), "groups"))


def near_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, links, copies), one row per row of ``docs``.

    ``class_id`` is the smallest id of the documents reached over links,
    ``links`` the number of different other texts whose word shingles have at
    least the Jaccard similarity, ``copies`` the rows with the very same text.
    A text shorter than a shingle has one of all its words; NULL counts as the
    empty text, which has no links.  NULL ids count as largest.
    """
    found = join(docs, words, threshold, recall)
    return found.rows.join(found.classes, "_id").select(
        F.col("_doc").alias("doc_id"), F.col("_head._doc").alias("class_id"),
        F.col("_links").alias("links"), F.col("_copies").alias("copies"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The first document, by id, of each group of equal and near texts, all columns;
    of rows equal in id and text one.  Empty texts are equal too."""
    found = join(docs)
    rows = found.rows.join(found.classes, "_id")
    gone = stored(
        rows.where(~(F.col("_doc").eqNullSafe(F.col("_head._doc")) & (F.col("_th") == F.col("_head._th"))))
        .select("_doc", "_th").distinct(),
        "near_copies",
    )
    key, doc, th = (free(docs, n) for n in ("_t", "_gone_doc", "_gone_th"))
    gone = gone.toDF(doc, th)
    left = docs.withColumn(key, F.xxhash64("text"))
    kept = left.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(th)), "left_anti")
    again = found.rows.groupBy("_doc", "_th").count().where("count > 1").limit(1).count()
    if again:
        kept = kept.dropDuplicates(["doc_id", key])
    return kept.drop(key)
