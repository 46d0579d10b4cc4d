"""Line dedup by a deletion-neighbourhood join.

Two lines within one edit share a variant: both with the character at one place
left out, or the shorter one whole and the longer one less a character.  Each
line emits all its variants as hashed keys, lines meet at equal keys, the edit
distance is verified on the texts, and the earliest line stays.

Most lines have no such partner, and one key per character of everything would
be a table larger than the text.  So blocks are left out before characters: at
one edit all blocks but one are equal, and what has no partner with a half left
out, and then with a sixteenth left out, cannot have one with a character left
out; and the character is in the sixteenth that matched.  That loses no pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import free, small_batches, stored

NEAR = 20  # characters a line needs for one edit to be a small change; shorter ones must be equal
BLOCKS = 16
BROADCAST_BYTES = 16 << 20  # of places of candidate lines
PLACE_BYTES, DOC_BYTES = 40, 60  # of a place, and of a document's id, in a broadcast table
ROWS_OUT = 100_000  # keys that a task hands over at once
_ID = ["_k1", "_k2"]


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def block_keys(s: str, blocks: int) -> list[int]:
    """Keys of ``s`` with each of its blocks left out: by the blocks of its own
    length, and by those of a line one character shorter."""
    out = []
    n = len(s)
    for size in (n, n - 1):
        shift = n - size
        for q in range(blocks):
            a, b = q * size // blocks, (q + 1) * size // blocks
            out.append(xxhash.xxh3_64_intdigest(f"{size}/{q}/{s[:a]}\x00{s[b + shift :]}".encode("utf-8", "surrogatepass")))
    return out


def variant_keys(s: str, blocks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of ``s`` with one character of the given blocks (places among its
    ``block_keys``) left out, and their roles.

    Role 0 knows its place and meets lines of equal length; role 1 is a longer
    line less a character and meets role 2, a line as it is.
    """
    points = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points)
    fore, back = K._powers(n.bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(points + np.uint64(1)) * fore[:n])))
    sizes = np.array([n - 1, n], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def without(at: np.ndarray) -> np.ndarray:
        return K.mix(sums[at] + (sums[-1] - sums[at + 1]) * back[1] + sizes[0])

    same, longer = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for q in blocks:
        if q < BLOCKS:
            same[q * n // BLOCKS : (q + 1) * n // BLOCKS] = True
        else:
            longer[(q - BLOCKS) * (n - 1) // BLOCKS : (q - BLOCKS + 1) * (n - 1) // BLOCKS + 1] = True
    at, out = np.flatnonzero(same), np.flatnonzero(longer)
    placed = K.mix(without(at) ^ ((at.astype(np.uint64) + np.uint64(1)) << np.uint64(20)))
    whole = K.mix(sums[-1:] + sizes[1:])
    keys = np.concatenate((placed, without(out), whole))
    return keys.view(np.int64), np.repeat(np.array([0, 1, 2], dtype=np.int32), [len(at), len(out), 1])


def within_one(a: str, b: str) -> bool:
    """Edit distance of at most one."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


LINE_SCHEMA = "_doc long, _th long, _no int, _k1 long, _k2 long, _keys array<long>"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct line of a text, at its first place there."""
    for batch in batches:
        docs, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi, _, _ in K.runs(batch.column(2)):
            own, th, no, ids, keys = [], [], [], [], []
            for i, text in enumerate(batch.column(2).slice(lo, hi - lo).to_pylist(), lo):
                seen = set()
                for k, line in enumerate((text or "").split("\n")):
                    s = normal(line)
                    if not s or s in seen:
                        continue
                    seen.add(s)
                    own.append(docs[i])
                    th.append(hashes[i])
                    no.append(k)
                    ids.append(xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")))
                    keys.append(block_keys(s, 2) if len(s) >= NEAR else [])
            pair = np.frombuffer(b"".join(ids), dtype=np.int64).reshape(-1, 2)
            flat = [k for row in keys for k in row]
            offs = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own, pa.int64()), pa.array(th, pa.int64()), pa.array(no, pa.int32()),
                    pa.array(pair[:, 0]), pa.array(pair[:, 1]),
                    pa.ListArray.from_arrays(pa.array(offs), _signed(flat)),
                ],
                ["_doc", "_th", "_no", "_k1", "_k2", "_keys"],
            )


def _partnered(keyed: DataFrame) -> DataFrame:
    """The rows whose key another line has too."""
    shared = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_key")
    return keyed.join(shared, "_key", "left_semi")


def _per_line(df: DataFrame, given: list[str], make: Callable[..., tuple], names: list[str], schema: str) -> DataFrame:
    """Rows that ``make`` gives for the text of each line, after its id and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = zip(*(batch.column(c).to_pylist() for c in given), strict=True)
            of: list[int] = []
            sizes: list[int] = []
            parts: list[list] = []

            def made() -> pa.RecordBatch:
                rows = pa.array(np.repeat(np.array(of, np.int64), sizes))
                columns = [batch.column(c).take(rows) for c in base]
                columns += [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
                return pa.RecordBatch.from_arrays(columns, [*base, *names])

            for i, values in enumerate(inputs):
                parts.append(make(*values))
                of.append(i)
                sizes.append(len(parts[-1][0]))
                if sum(sizes) > ROWS_OUT:
                    yield made()
                    of, sizes, parts = [], [], []
            if parts:
                yield made()

    base = ["_k1", "_k2", "_first"]
    fields = [f for f in df.schema.fields if f.name in base]
    order = {n: i for i, n in enumerate(base)}
    out = T.StructType(sorted(fields, key=lambda f: order[f.name]) + T._parse_datatype_string(schema).fields)
        # Each row gives many: dealt out anew, so that a small table is not one task.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*base, *given).repartition(parts, *_ID).transform(small_batches).mapInArrow(run, out)


def _decided(ties: DataFrame) -> DataFrame:
    """(ids, _other): the lines that go, each with a line that stays and covers it.

    ``ties`` are lines at keys; at a key of kind 0 all lines are near each other, at
    one of kind 1 the shorter lines (``_side``) and the longer ones.  In rounds: a
    line without an earlier one near it stays, one near an earlier line that stays
    goes, and others wait for those before them.  So a line that went covers none.
    The earliest line that waits is decided in every round; only what still waits,
    and what that is near to, goes into the next.
    """
    rep = F.struct("_first", *_ID)
    now = ties.withColumn("_stays", F.lit(False))
    gone = []
    while True:
        stays, side = F.col("_stays"), F.col("_side")
        heads = now.groupBy("_key", "_kind").agg(
            F.min(F.when(~side, rep)).alias("_long"), F.min(F.when(side, rep)).alias("_short"),
            F.min(F.when(~side & stays, rep)).alias("_klong"), F.min(F.when(side & stays, rep)).alias("_kshort"),
            F.count_if(~stays).alias("_open"),
        )
        met = now.join(heads.where("_open > 0"), ["_key", "_kind"])
        across = F.col("_kind") & ~side
        other, cover = (F.when(across, F.col(b)).otherwise(F.col(a)) for a, b in (("_long", "_short"), ("_klong", "_kshort")))
        met = stored(met.select(*now.columns, other.alias("_o"), cover.alias("_c")), "met_lines")
        earlier = [F.when(F.col(f"{c}._first") < F.col("_first"), F.col(c)) for c in ("_o", "_c")]
        asked = met.where("not _stays").groupBy(*_ID).agg(F.min(earlier[0]).alias("_wait"), F.min(earlier[1]).alias("_other"))
        asked = stored(asked, "asked_lines")
        gone.append(asked.where("_other is not null").select(*_ID, "_other"))
        out = asked.select(*_ID, F.col("_other").isNotNull().alias("_gone"), F.col("_wait").isNull().alias("_free"))
        left = met.drop("_o", "_c").join(out, _ID, "left").where(~F.coalesce("_gone", F.lit(False)))
        now = left.withColumn("_stays", F.col("_stays") | F.coalesce("_free", F.lit(False))).drop("_gone", "_free")
        if not asked.where("_other is null and _wait is not null").limit(1).count():
            return reduce(DataFrame.union, gone)


def covered(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Ids of the distinct lines that have an earlier line that stays within one edit."""
    keyed = distinct.where(F.size("_keys") > 0).select(*_ID, F.explode("_keys").alias("_key"))
    met = distinct.select(*_ID, "_first").join(_partnered(keyed).select(*_ID).distinct(), _ID)
    places = stored(
        met.groupBy(F.col("_first._doc").alias("_d"), F.col("_first._th").alias("_t")).agg(
            F.collect_list(F.struct("_k1", "_k2", "_first")).alias("_at")
        ),
        "candidate_lines",
    )
    # One row per document; broadcast if measured to be small, else documents are shuffled once more.
    size = places.agg(F.sum(F.size("_at") * PLACE_BYTES + DOC_BYTES)).first()[0] or 0
    right = F.broadcast(places) if size <= BROADCAST_BYTES else places
    hit = docs.join(right, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")))
    # Equal rows of a document give the same lines again.
    fields = T.StructType([T.StructField("_line", T.StringType()), *distinct.select(*_ID, "_first").schema.fields])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = text.split("\n")
                out += [{"_line": normal(lines[x["_first"]["_no"]]), **x} for x in at]
            yield pa.RecordBatch.from_pylist(out, schema=_arrow(fields))

    texts = hit.select("_text", "_at").transform(small_batches).mapInArrow(pick, fields).dropDuplicates(_ID)
    texts = stored(texts, "candidate_texts")
    q = np.arange(2 * BLOCKS, dtype=np.int32)
    blocks = _per_line(
        texts, ["_line"], lambda s: (np.array(block_keys(s, BLOCKS), dtype=np.uint64).view(np.int64), q),
        ["_key", "_q"], "_key long, _q int",
    )
    near = _partnered(blocks.select(*_ID, "_key", "_q")).groupBy(*_ID).agg(F.collect_set("_q").alias("_qs"))
    texts = stored(texts.join(near, _ID), "near_lines")
    keys = _per_line(texts, ["_line", "_qs"], variant_keys, ["_key", "_role"], "_key long, _role int")
    # 0 meets 0; 1, a longer line less a character, meets 2, a shorter line.
    keys = keys.select(*_ID, "_first", "_key", (F.col("_role") > 0).alias("_kind"), (F.col("_role") == 2).alias("_side"))
    keys = stored(keys, "variants")
    shared = keys.groupBy("_key", "_kind").agg(F.count_if("_side").alias("_s"), F.count(F.lit(1)).alias("_c"))
    shared = shared.where("_c > 1 and (not _kind or (_s > 0 and _s < _c))").select("_key", "_kind")
    best = _decided(stored(keys.join(shared, ["_key", "_kind"], "left_semi"), "ties"))
    mine = texts.select(*_ID, F.col("_line").alias("_a"))
    theirs = texts.select(F.col("_k1").alias("_o1"), F.col("_k2").alias("_o2"), F.col("_line").alias("_b"))
    pairs = best.join(mine, _ID).join(
        theirs, (F.col("_other._k1") == F.col("_o1")) & (F.col("_other._k2") == F.col("_o2"))
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("_a").to_pylist(), batch.column("_b").to_pylist()
            yield batch.select(_ID).filter(pa.array([within_one(x, y) for x, y in zip(a, b, strict=True)], pa.bool_()))

    return pairs.select(*_ID, "_a", "_b").transform(small_batches).mapInArrow(verify, "_k1 long, _k2 long")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def dedup_lines(docs: DataFrame, added: tuple[str, str] = ("lines_dropped", "lines_kept")) -> DataFrame:
    """Documents with only the earliest of equal and nearly equal lines.

    Lines are compared in lower case with white space squeezed.  A line goes if
    an earlier one, by (doc_id, text hash, line number), is equal to it or, both
    having ``NEAR`` characters or more, within one edit of it and stays itself.  Blank lines stay.  NULL ids
    count as earliest; rows equal in id and text are one document and keep the
    same lines; a NULL text stays NULL.  All columns stay, ``n_chars`` follows
    the text if it is there, and two counts are added, ``added`` by name: lines
    dropped, and lines kept without blank ones.  A column of the caller's that has
    such a name is an error, so name others then.
    """
    clash = {c.lower() for c in docs.columns} & {c.lower() for c in added}
    if clash:
        raise ValueError(f"columns of these names are added: {sorted(clash)}")
    names = docs.columns
    slim = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_th"), F.col("text").alias("_text"))
    lines = slim.transform(small_batches).mapInArrow(_lines, LINE_SCHEMA)
    distinct = stored(
        lines.groupBy(*_ID).agg(
            F.min(F.struct("_doc", "_th", "_no")).alias("_first"), F.first("_keys").alias("_keys")
        ),
        "distinct_lines",
    )
    gone = stored(covered(slim, distinct), "covered_lines")
    key, doc, th, mine = (free(docs, n) for n in ("_th", "_kept_doc", "_kept_th", "_kept"))
    kept = (
        distinct.select(*_ID, "_first")
        .join(gone, _ID, "left_anti")
        .groupBy(F.col("_first._doc").alias(doc), F.col("_first._th").alias(th))
        .agg(F.collect_list("_first._no").alias(mine))
    )
    joined = docs.withColumn(key, F.xxhash64("text")).join(
        kept, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(th)), "left"
    )
    out = T.StructType(
        [*docs.schema.fields, *[T.StructField(c, T.IntegerType()) for c in added]]
    )

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, dropped, left = [], [], [], []
            for text, kept in zip(batch.column("text").to_pylist(), batch.column(mine).to_pylist(), strict=True):
                keep = set(kept or ())
                lines = (text or "").split("\n")
                blank = [not x.strip() for x in lines]
                stay = [x for k, x in enumerate(lines) if blank[k] or k in keep]
                dropped.append(len(lines) - len(stay))
                left.append(len(keep))
                texts.append(None if text is None else "\n".join(stay) if dropped[-1] else text)
                sizes.append(None if text is None else len(texts[-1]))
            columns = {n: batch.column(n) for n in names}
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(sizes, pa.int64()).cast(columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(
                [*columns.values(), pa.array(dropped, pa.int32()), pa.array(left, pa.int32())],
                [*columns, *added],
            )

    return joined.select(*names, mine).transform(small_batches).mapInArrow(rebuild, out)
