"""SentencePiece encoding with sampled segmentations, and lossless decoding.

The pieces of a public model span a lattice over a text; a piece's weight falls
with its rank.  Forward filtering sums the weights of all ways to reach a place,
backward sampling draws a way from the end.  No piece crosses from a word into
the next space, so the lattice falls apart at words, and its forward pass is run
once for each distinct word of a run of texts.  The draws depend on the row's
key, the word's place and the step only, so they are the same in any batch.

A space is written as the piece sign; a text gets one in front.  A character
without a piece of its own, and the sign itself in a text, become byte pieces,
so decoding gives back every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SIGN, STOP = 0xFF, 0xFE  # a space, and the end of a word, inside; no UTF-8 text has these bytes
SEED = 20240601
RUN = 1_900_000  # bytes of texts encoded at once
BATCH = 160_000  # bytes of distinct words whose lattices are made at once
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Model:
    """Pieces as a trie over bytes, with log weights and the bytes they decode to."""

    def __init__(self, path: str, sharpness: float = 1.0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.byte = np.zeros(256, dtype=np.int32)
        out: list[bytes] = [b""] * n
        step: dict[int, int] = {}
        ends: dict[int, int] = {}
        nodes = 1
        rank = np.arange(n, dtype=np.float64) + 3
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte[b] = i
                out[i] = bytes([b])
            elif not (sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)):
                raw = b"".join(b"\xff" if c == "▁" else c.encode() for c in piece)
                out[i] = raw.replace(b"\xff", b" ")
                node = 0
                for c in raw:
                    key = node << 8 | c
                    if key not in step:
                        step[key] = nodes
                        nodes += 1
                    node = step[key]
                ends[node] = i
        self.child = np.zeros(nodes << 8, dtype=np.uint16 if nodes < 1 << 16 else np.uint32)
        self.child[list(step)] = list(step.values())
        self.piece = np.full(nodes, -1, dtype=np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.inner = np.zeros(nodes, dtype=bool)
        self.inner[np.array(list(step)) >> 8] = True
        self.weight = -sharpness * np.log(rank)
        self.byte_weight = float(self.weight[-1]) * 1.5
        self.size = np.array([len(b) for b in out], dtype=np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.raw = np.frombuffer(b"".join(out), dtype=np.uint8)

    # -- encoding ---------------------------------------------------------

    def _lattice(self, data: np.ndarray, bounds: np.ndarray):
        """Edges (start, piece or -1, probability of coming this way) by end place,
        and for each place its first edge and number of edges.  Each word ends in
        ``STOP``, where every walk through the trie dies."""
        n = len(data)
        heads = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        size = np.diff(np.append(heads, n)).astype(np.int32)
        solid = data[heads] != STOP
        heads, size = heads[solid], size[solid]
        lone = np.zeros(n, dtype=bool)  # has a piece for just this character
        starts, ends, ids = [], [], []
        at, node, length = heads, np.zeros(len(heads), dtype=np.int32), 0
        width = np.zeros(n, dtype=np.int32)
        width[heads] = size
        while len(at):
            node = self.child[(node << np.int32(8)) | data[at + np.int32(length)]].astype(np.int32)
            length += 1
            live = np.flatnonzero(node)
            at, node = at[live], node[live]
            found = self.piece[node]
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                s = at[hit]
                starts.append(s)
                ends.append(s + np.int32(length))
                ids.append(found[hit])
                lone[s[width[s] == length]] = True
            go = np.flatnonzero(self.inner[node])
            at, node = at[go], node[go]
        rest = heads[~lone[heads]]
        starts.append(rest)
        ends.append(rest + width[rest])
        ids.append(np.full(len(rest), -1, dtype=np.int32))
        start, end, piece = np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)
        order = np.argsort(end, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        weight = self.weight[piece]
        weight[piece < 0] = self.byte_weight * (end - start)[piece < 0]
        first_edge = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
        places = end[first_edge]
        count = np.diff(np.append(first_edge, len(end)))
        # Forward: all words at once, by how far into the word the place is.
        word_start = np.repeat(bounds[:-1], np.diff(bounds))
        depth = places - word_start[places - 1]
        turn = np.argsort(depth.astype(np.uint16) if depth.max() < 65536 else depth, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(depth[turn]) > 0, [True])))
        size = count[turn]
        base = np.cumsum(size) - size
        edges = np.repeat(first_edge[turn] - base, size) + np.arange(len(end))
        log = np.zeros(n + 1)
        prob = np.empty(len(end), dtype=np.float32)
        w, s = weight[edges], start[edges]
        place_of = places[turn]
        bases = np.append(base, len(end))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = bases[a], bases[b]
            # A word's start has log weight 0, whatever word ended there before.
            v = w[lo:hi] + np.where(s[lo:hi] == word_start[s[lo:hi]], 0.0, log[s[lo:hi]])
            cut = bases[a:b] - lo
            top = np.maximum.reduceat(v, cut)
            e = np.exp(v - np.repeat(top, size[a:b]))
            total = np.add.reduceat(e, cut)
            log[place_of[a:b]] = top + np.log(total)
            prob[lo:hi] = e / np.repeat(total, size[a:b])
        by_edge = np.empty(len(end), dtype=np.float32)
        by_edge[edges] = prob
        first = np.zeros(n + 1, dtype=np.int64)
        many = np.zeros(n + 1, dtype=np.int64)
        first[places], many[places] = first_edge, count
        return start, piece, by_edge, first, many

    def _lattices(self, data: np.ndarray, bounds: np.ndarray):
        """The same, made for some words at a time, so that the work stays in cache."""
        starts, pieces, probs = [], [], []
        n = len(data)
        first, many = np.zeros(n + 1, dtype=np.int32), np.zeros(n + 1, dtype=np.int32)
        lo, edges = 0, 0
        while lo < len(bounds) - 1:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + BATCH, side="right")) - 1)
            a, b = int(bounds[lo]), int(bounds[hi])
            s, p, q, f, m = self._lattice(data[a:b], bounds[lo : hi + 1] - a)
            starts.append(s + np.int32(a))
            pieces.append(p)
            probs.append(q)
            first[a:b], many[a:b] = f[:-1] + edges, m[:-1]
            edges += len(s)
            lo = hi
        return np.concatenate(starts), np.concatenate(pieces), np.concatenate(probs), first, many

    def encode(self, texts: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and each text's offset among them."""
        raw = b"".join(b" " + t if t else b"" for t in texts)
        lens = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        if not raw:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(raw, dtype=np.uint8).copy()
        data[data == 32] = SIGN
        edge = np.concatenate(([0], np.cumsum(lens)))
        sign = data == SIGN
        opens = sign.copy()
        opens[1:] &= ~sign[:-1]
        opens[edge[:-1][lens > 0]] = True
        start = np.flatnonzero(opens)
        end = np.append(start[1:], len(data))
        text_of = np.searchsorted(edge, start, side="right") - 1
        nth = np.arange(len(start)) - np.searchsorted(start, edge[:-1])[text_of]
        # Distinct words; equal hashes are held against the bytes.
        _, first, word = np.unique(K.Spans(data)(start, end), return_index=True, return_inverse=True)
        size = end - start
        twin = np.repeat(start[first][word] - start, size) + np.arange(len(data))
        if not (data[np.minimum(twin, len(data) - 1)] == data).all() or (size[first][word] != size).any():
            first = word = np.arange(len(start))
        # Shorter words first: words made together then take about as many steps.
        order = np.argsort(size[first], kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        first, word = first[order], place[word]
        wide = size[first] + 1
        bounds = np.concatenate(([0], np.cumsum(wide)))
        words = np.append(data, STOP)[np.repeat(start[first] - bounds[:-1], wide) + np.arange(bounds[-1])]
        words[bounds[1:] - 1] = STOP
        e_start, e_piece, prob, e_first, e_many = self._lattices(words, bounds)
        # Backward: one edge per step for all words that have not reached their start.
        occ = np.arange(len(start))
        now = bounds[1:][word] - 1
        key = keys[text_of] + (nth.astype(np.uint64) + np.uint64(1)) * _C1
        picked, owners, steps = [], [], 0
        count = np.zeros(len(start), dtype=np.int64)
        begin = bounds[:-1][word]
        while len(occ):
            u = (K.mix(key[occ] + _stream(steps)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            at = e_first[now]
            last = at + e_many[now] - 1
            u -= prob[at]
            more = np.flatnonzero((u >= 0) & (at < last))
            while len(more):
                at[more] += 1
                u[more] -= prob[at[more]]
                more = more[(u[more] >= 0) & (at[more] < last[more])]
            picked.append(at)
            owners.append(occ)
            count[occ] += 1
            now = e_start[at].astype(np.int64)
            go = now > begin[occ]
            occ, now = occ[go], now[go]
            steps += 1
        offset = np.concatenate(([0], np.cumsum(count)))
        seq = np.empty(offset[-1], dtype=np.int64)
        for k, (own, at) in enumerate(zip(owners, picked, strict=True)):
            seq[offset[own + 1] - 1 - k] = at
        ids = e_piece[seq]
        per_text = offset[np.searchsorted(text_of, np.arange(len(texts) + 1))]
        if (ids < 0).any():
            ids, per_text = self._bytes(words, seq, ids, e_start, per_text)
        return ids, per_text

    def _bytes(self, words, seq, ids, e_start, per_text):
        """Write characters without a piece as byte pieces."""
        at = e_start[seq]
        size = np.ones(len(ids), dtype=np.int64)
        lost = np.flatnonzero(ids < 0)
        lead = words[at[lost]]
        size[lost] = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        ends = np.concatenate(([0], np.cumsum(size)))
        out = np.repeat(ids, size)
        for k in range(4):
            some = lost[size[lost] > k]
            out[ends[some] + k] = self.byte[words[at[some] + k]]
        return out, ends[per_text]

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> list[bytes]:
        size = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        out = self.raw[np.repeat(self.at[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cut = ends[offs].tolist()
        return [out[a + 1 : b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


@lru_cache(maxsize=2)
def model(path: str, sharpness: float = 1.0) -> Model:
    return Model(path, sharpness)


def _stream(step: int) -> np.uint64:
    return np.uint64((step + 1) * int(_C2) % (1 << 64))


def row_keys(ids: list, seed: int) -> np.ndarray:
    """One random stream per row key; NULL has its own."""
    raw = np.array([0 if i is None else i for i in ids], dtype=np.int64).view(np.uint64)
    none = np.array([i is None for i in ids], dtype=bool)
    return K.mix(raw ^ K.mix(np.array([seed], dtype=np.uint64)) ^ np.where(none, _C1, np.uint64(0)))


def encode(docs: DataFrame, path: str = MODEL, seed: int = SEED, sharpness: float = 1.0, out: str = "pieces") -> DataFrame:
    """Add the sampled piece ids of ``text``, drawn by ``doc_id`` and ``seed``.

    A NULL text gives NULL, an empty one no pieces; rows of equal id and text
    give equal pieces.  A column named ``out`` is replaced.
    """
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, sharpness)
        for batch in batches:
            text, keys = batch.column("text"), row_keys(batch.column("doc_id").to_pylist(), seed)
            for lo, hi, _, _ in K.runs(text, RUN):
                part = batch.slice(lo, hi - lo)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
                ids, offs = m.encode(texts, keys[lo:hi])
                lists = pa.ListArray.from_arrays(
                    pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=part.column("text").is_null()
                )
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.withColumn("doc_id", F.col("doc_id").cast("long")).transform(small_batches).mapInArrow(run, schema)


def decode(rows: DataFrame, pieces: str = "pieces", path: str = MODEL, out: str = "decoded") -> DataFrame:
    """Add the text that piece ids stand for; NULL stays NULL."""
    rows = rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(pieces)
                offs = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
                texts = m.decode(lists.flatten().to_numpy(zero_copy_only=False), offs)
                nulls = lists.is_null().to_pylist()
                found = [None if n else t.decode("utf-8", "surrogatepass") for t, n in zip(texts, nulls, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*part.schema.names, out])

    return rows.transform(small_batches).mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())]))
