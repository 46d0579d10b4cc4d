"""Token counts that follow edits.

A text is cut into pre-tokens by the tokenizer's own pattern, and each pre-token
is encoded alone, so a document's count is the sum over its pre-tokens.  They
are kept per document as the leaves of a segment tree whose nodes hold the
characters and the tokens below them.  An edit finds its place by the character
sums, cuts the touched leaves anew from a boundary that the edit cannot have
moved until the cuts fall together with the old ones again, encodes only the
pre-tokens in between, and updates the sums on the way up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 32  # pre-tokens of a leaf
CONTEXT = 2  # characters after its end that can decide where a pre-token ends
KNOWN = 400_000  # pre-tokens whose counts a task remembers


class Encoder:
    """Cuts texts into pre-tokens and counts the tokens of each."""

    def __init__(self, path: str = VOCABULARY):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._pattern = regex.compile(PATTERN)
        self._known: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        return self._pattern.findall(text)

    def ends(self, text: str) -> Iterator[int]:
        for m in self._pattern.finditer(text):
            yield m.end()

    def count(self, piece: str) -> int:
        n = self._known.get(piece)
        if n is None:
            if len(self._known) > KNOWN:
                self._known.clear()
            n = self._known[piece] = len(self._bpe._encode_single_piece(piece.encode("utf-8", "replace")))
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        known, count = self._known.get, self.count
        return [known(p) or count(p) for p in pieces]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Tree:
    """The segment tree of one document: leaves of pre-token lengths and token
    counts, and in heap order the sums of characters and tokens."""

    def __init__(self, sizes: list[int], counts: list[int]):
        self._build([(sizes[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(sizes), LEAF)] or [([], [])])
        self.encoded = 0

    def _build(self, leaves: list[tuple[list[int], list[int]]]) -> None:
        self.leaves = leaves
        self.width = 1 << (len(leaves) - 1).bit_length()
        pad = [0] * (self.width - len(leaves))
        self.chars = [0] * self.width + [sum(s) for s, _ in leaves] + pad
        self.tokens = [0] * self.width + [sum(c) for _, c in leaves] + pad
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character (or the last one), and where it begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if place >= begin + self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.width, begin

    def _set(self, leaf: int, sizes: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = (sizes, counts)
        node = leaf + self.width
        chars, tokens = sum(sizes) - self.chars[node], sum(counts) - self.tokens[node]
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def edit(self, text: str, start: int, stop: int, new: str, enc: Encoder) -> str:
        """Put ``new`` in place of ``text[start:stop]``; give the new text.  Places
        beyond the text are taken as its end."""
        start = max(0, min(start, len(text)))
        stop = max(start, min(stop, len(text)))
        first, begin = self.find(max(start - CONTEXT, 0))
        sizes, counts = self.leaves[first]
        # The last boundary that looked at nothing the edit changes.
        skip = 0
        while skip < len(sizes) and begin + sizes[skip] <= start - CONTEXT:
            begin += sizes[skip]
            skip += 1
        head_s, head_c = sizes[:skip], counts[:skip]
        edited = text[:start] + new + text[stop:]
        shift = len(new) - (stop - start)
        # Old boundaries from here on, leaf by leaf, as they are needed.
        leaf, at = first, skip
        old = begin
        done: list[int] = []
        last = begin
        wide = 256
        ends: Iterator[int] = iter(())
        window_end = begin
        tail_s: list[int] = []
        tail_c: list[int] = []
        while last < len(edited):
            end = next(ends, None)
            if end is None or (end + CONTEXT > window_end - begin and window_end < len(edited)):
                # Cut a longer stretch, again from the last boundary that is sure.
                begin = last
                window_end = min(len(edited), max(start + len(new), last) + wide)
                wide *= 4
                ends = enc.ends(edited[begin:window_end])
                continue
            place = begin + end
            done.append(place - last)
            piece = edited[last:place]
            tail_c.append(enc.count(piece))
            self.encoded += 1
            last = place
            if place >= start + len(new):
                while old < place - shift and leaf < len(self.leaves):
                    s = self.leaves[leaf][0]
                    if at < len(s):
                        old += s[at]
                        at += 1
                    else:
                        leaf, at = leaf + 1, 0
                if old == place - shift and old >= stop:
                    break
        else:
            leaf, at = len(self.leaves), 0
        if leaf < len(self.leaves):
            tail_s = self.leaves[leaf][0][at:]
            rest_c = self.leaves[leaf][1][at:]
        else:
            rest_c = []
        for k in range(first + 1, min(leaf + 1, len(self.leaves))):
            self._set(k, [], [])
        self._set(first, head_s + done + tail_s, head_c + tail_c + rest_c)
        if len(self.leaves[first][0]) > 16 * LEAF:
            flat_s = [x for s, _ in self.leaves for x in s]
            flat_c = [x for _, c in self.leaves for x in c]
            self._build([(flat_s[i : i + LEAF], flat_c[i : i + LEAF]) for i in range(0, len(flat_s), LEAF)])
        return edited


def plant(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text, edits, sizes, counts): the leaves of every document's tree,
    with the texts and edits they belong to.  NULL counts as the empty text; equal
    rows give equal trees, and no rows none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                cut = [enc.cut(t or "") for t in part.column("text").to_pylist()]
                ends = pa.array(list(accumulate(map(len, cut), initial=0)), pa.int32())
                flat = [p for pieces in cut for p in pieces]
                sizes = pa.ListArray.from_arrays(ends, pa.array(np.fromiter(map(len, flat), np.int32, len(flat))))
                counts = pa.ListArray.from_arrays(ends, pa.array(np.array(enc.counts(flat), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, sizes, counts], [*part.schema.names, "sizes", "counts"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", "edits")
    schema = "doc_id long, text string, edits array<struct<start:int,stop:int,text:string>>, sizes array<int>, counts array<int>"
    return rows.transform(small_batches).mapInArrow(run, schema)


EDITED = "doc_id long, pieces long, n_tokens long, edited_tokens long, encoded long, edited string"
LEAVES = "sizes array<int>, counts array<int>"


def apply_edits(trees: DataFrame, path: str = VOCABULARY, leaves: bool = True) -> DataFrame:
    """(doc_id, pieces, n_tokens, edited_tokens, encoded, edited, sizes, counts): the
    counts before and after the edits, which apply one after another, the pre-tokens
    that were encoded for them, the edited text and the leaves of its tree.

    A NULL edit list is no edit, a NULL text the empty text, a NULL place the text's
    start; places beyond the text are its end.  Without ``leaves`` only the counts
    and the text are given; with them :func:`kept` goes on to a next batch of edits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kinds = [pa.int64()] * 5 + [pa.string()] + [pa.list_(pa.int32())] * 2 * leaves
        names = ["doc_id", "pieces", "n_tokens", "edited_tokens", "encoded", "edited"] + ["sizes", "counts"] * leaves
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                out = []
                for row in batch.slice(lo, 512).to_pylist():
                    tree = Tree(row["sizes"], row["counts"])
                    before, text = tree.total, row["text"] or ""
                    for e in row["edits"] or ():
                        text = tree.edit(text, e["start"] or 0, e["stop"] or 0, e["text"] or "", enc)
                    values = [row["doc_id"], len(row["sizes"]), before, tree.total, tree.encoded, text]
                    if leaves:
                        values += [[x for s, _ in tree.leaves for x in s], [x for _, c in tree.leaves for x in c]]
                    out.append(values)
                columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return trees.transform(small_batches).mapInArrow(run, f"{EDITED}, {LEAVES}" if leaves else EDITED)


def kept(edited: DataFrame, edits: DataFrame) -> DataFrame:
    """The trees that :func:`apply_edits` left, with a next batch of edits (see
    :func:`with_edits`), ready for it again: nothing is cut or encoded anew."""
    return with_edits(edited.select("doc_id", F.col("edited").alias("text"), "sizes", "counts"), edits)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with their ``edits`` from a table (doc_id, seq, start, stop, text), in
    the order of ``seq``; of ``docs`` the columns doc_id, text and, if there, the
    leaves stay.  A document without edits, or of NULL id, has a NULL list."""
    docs = docs.select("doc_id", "text", *[c for c in ("sizes", "counts") if c in docs.columns])
    each = edits.groupBy(F.col("doc_id").alias("_e")).agg(
        F.array_sort(F.collect_list(F.struct("seq", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "text"))).alias("edits")
    )
    joined = docs.join(each, docs["doc_id"] == F.col("_e"), "left").drop("_e")
    return joined.withColumn("edits", F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["text"].alias("text"))))
