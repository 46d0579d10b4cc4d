"""Quality rules by tokeniser fertility.

Public vocabularies were made for clean text, so text that they cut in an unusual
way is seldom clean.  Each text is measured by characters per token under two
vocabularies, by the share of byte-fallback tokens and by the entropy of its
tokens.  A document is rejected if a measure lies outside the band of its
language, or of its script where the language is not known, among texts of its
length: short texts scatter more, and long ones repeat more of their tokens.
Bands come from the quartiles of all documents of the group that pass the plain
rules, so they move with the corpus and need no labels.

Tokens never cross a word, so every distinct word of a run of texts is encoded
once and texts are sums over their words.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import free, small_batches, stored

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that belongs to the ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACED = re.compile(r"\s|[\x1c-\x1f]").search
LONG = 512  # characters of a word encoded at once; a longer word is encoded in parts
KNOWN = 300_000  # distinct words whose tokens a task remembers
WINDOW = 8  # words of a window that is looked for again
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of words in repeated windows
SYMBOLS = "#*$%&|<>"
MEASURES = ("piece_chars", "rank_chars", "byte_share", "entropy")
WIDTH = 2.0  # a band reaches this many quartile ranges beyond the quartiles,
FLOOR = {"piece_chars": 0.15, "rank_chars": 0.15, "byte_share": 0.02, "entropy": 0.03}  # and so far at least
CELL = 1 / 1024  # measures are counted in cells of this width
BROADCAST_BANDS = 20_000  # rows of 11 numbers and a group's name
LEAST_GROUP = 50  # documents that a band is made from at least; a smaller group has none
SCRIPTS = {  # fixed values: first and last code points of the letters of common scripts
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F)),
    "greek": ((0x370, 0x3FF),),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF),),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7A3)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}

STATS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens")]
    + [T.StructField(n, T.DoubleType()) for n in MEASURES]
    + [T.StructField("script", T.StringType())]
)


class Vocabularies:
    """Tokens of single words under the piece model, and counts under the ranks."""

    def __init__(self, pieces: str, ranks: str):
        import sentencepiece
        import tiktoken

        self._pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.size = self._pieces.vocab_size()
        self.is_byte = np.array([self._pieces.is_byte(i) for i in range(self.size)])
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._ranks = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self._rank_size = np.zeros(len(table), dtype=np.int64)
        self._rank_size[list(table.values())] = list(map(len, table))
        self._forget()

    def _forget(self) -> None:
        # Words by hash: their place among the words, whose tokens lie one after the other.
        self._slot: dict[int, int] = {}
        self.offset = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.ranked = np.zeros(0, dtype=np.int64)

    def encode(self, words: list[str]) -> list[tuple[list[int], int]]:
        """Piece ids, and the number of rank tokens, of each word after a space."""
        parts = [w[i : i + LONG] for w in words for i in range(0, max(len(w), 1), LONG)]
        ids = self._pieces.encode(parts, num_threads=1)
        ranked = self._rank_counts(parts)
        if len(parts) == len(words):
            return list(zip(ids, ranked, strict=True))
        out, k = [], 0
        for w in words:
            n = max(1, -(-len(w) // LONG))
            out.append(([i for part in ids[k : k + n] for i in part], sum(ranked[k : k + n])))
            k += n
        return out

    def _rank_counts(self, parts: list[str]) -> list[int]:
        """Rank tokens of each part after a space.  A space begins a pre-token, so no
        token goes from a part into the next one and one call encodes them all; parts
        with white space of their own are encoded one by one."""
        odd = {i: len(self._ranks.encode_ordinary(" " + p)) for i, p in enumerate(parts) if _SPACED(p)}
        raw = [b" " + (b"x" if i in odd else p.encode()) for i, p in enumerate(parts)]
        size = self._rank_size[self._ranks.encode_ordinary(b"".join(raw).decode())]
        end = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        counts = np.diff(np.searchsorted(np.cumsum(size), end, side="right"), prepend=0).tolist()
        for i, n in odd.items():
            counts[i] = n
        return counts

    def lookup(self, keys: list[int], word_at) -> np.ndarray:
        """The places, in ``offset`` and ``ranked``, of words given by hash; ``word_at``
        gives the word of a place in ``keys``."""
        if len(self._slot) + len(keys) > KNOWN:
            self._forget()
        new = [i for i, k in enumerate(keys) if k not in self._slot]
        for lo in range(0, len(new), 20_000):
            some = new[lo : lo + 20_000]
            found = self.encode([word_at(i) for i in some])
            sizes = np.fromiter((len(ids) for ids, _ in found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(ids for ids, _ in found), np.int32, int(sizes.sum()))
            self._slot.update(zip([keys[i] for i in some], range(len(self._slot), len(self._slot) + len(some)), strict=True))
            self.offset = np.concatenate((self.offset, self.offset[-1] + np.cumsum(sizes)))
            self.ids = np.concatenate((self.ids, flat))
            self.ranked = np.concatenate((self.ranked, np.fromiter((n for _, n in found), np.int64, len(found))))
        return np.fromiter(map(self._slot.__getitem__, keys), np.int64, len(keys))


@lru_cache(maxsize=1)
def vocabularies(pieces: str, ranks: str) -> Vocabularies:
    return Vocabularies(pieces, ranks)


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _lines(data: np.ndarray, offs: np.ndarray, spans: K.Spans) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((offs[:-1], breaks + 1)))
    end = np.sort(np.concatenate((offs[1:], breaks)))
    n = len(offs) - 1
    text_of = np.repeat(np.arange(n), 1 + np.diff(np.searchsorted(breaks, offs)))
    solid = np.concatenate(([0], np.cumsum(~K.SPACE[data])))
    full = solid[end] > solid[start]
    text_of = text_of[full]
    hashes = K.mix(spans(start[full], end[full]) + text_of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first = np.unique(hashes, return_index=True)
    return np.bincount(text_of, minlength=n) - np.bincount(text_of[first], minlength=n)


def _repeated(words: np.ndarray, per: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Words inside windows of ``WINDOW`` words that a text has twice or more."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(len(per) - 1, dtype=np.int64)
    h = text_of[: n - WINDOW + 1].astype(np.uint64) + np.uint64(1)
    for k in range(WINDOW):
        h = (h ^ words[k : n - WINDOW + 1 + k]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1)
        h ^= h >> np.uint64(29)
    whole = np.flatnonzero(text_of[: n - WINDOW + 1] == text_of[WINDOW - 1 :])
    _, at, count = np.unique(K.mix(h[whole]), return_inverse=True, return_counts=True)
    hit = whole[count[at] > 1]
    mark = np.zeros(n + 1, dtype=np.int64)
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + WINDOW, -1)
    return _sums(np.cumsum(mark[:-1]) > 0, per)


def _script_of(data: np.ndarray, offs: np.ndarray) -> list[str | None]:
    """The script of most letters of each text; of equals the first of ``SCRIPTS``."""
    ascii_ = _sums(((data | 32) >= 97) & ((data | 32) <= 122), offs)
    counts = np.zeros((len(SCRIPTS), len(offs) - 1), dtype=np.int64)
    if (data > 127).any():
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
        if len(points) == len(lead):
            at = np.searchsorted(lead, offs)
            for k, ranges in enumerate(SCRIPTS.values()):
                counts[k] = sum(_sums((points >= a) & (points <= b), at) for a, b in ranges)
    counts[0] = np.maximum(counts[0], ascii_)
    names = list(SCRIPTS)
    best = counts.argmax(axis=0)
    return [names[k] if counts[k, i] else None for i, k in enumerate(best)]


def statistics(data: np.ndarray, offs: np.ndarray, vocab: Vocabularies) -> list[np.ndarray | list]:
    """The columns of ``STATS`` for texts laid one after the other."""
    n = len(offs) - 1
    start, end, per = K.word_spans(data, offs)
    spans = K.Spans(data)
    words = spans(start, end)
    text_of = np.repeat(np.arange(n), np.diff(per))
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    n_words = np.diff(per)
    word_chars = _sums(lead[end] - lead[start], per)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS.encode())] = True

    # Tokens of the distinct words, then of each text as sums over (text, word).
    keys, first, code = np.unique(words, return_index=True, return_inverse=True)
    raw = data.tobytes()
    slots = vocab.lookup(keys.tolist(), lambda i: raw[start[first[i]] : end[first[i]]].decode("utf-8", "replace"))
    begin = vocab.offset[slots]
    sizes, ranked = vocab.offset[slots + 1] - begin, vocab.ranked[slots]
    in_bytes = np.concatenate(([0], np.cumsum(vocab.is_byte[vocab.ids])))
    n_tokens = _sums(sizes[code], per)
    n_bytes = _sums((in_bytes[begin + sizes] - in_bytes[begin])[code], per)
    n_ranked = _sums(ranked[code], per)
    pair, times = np.unique(text_of * max(len(keys), 1) + code, return_counts=True)
    text, word = pair // max(len(keys), 1), pair % max(len(keys), 1)
    spread = sizes[word]
    inside = np.arange(int(spread.sum())) - np.repeat(np.cumsum(spread) - spread, spread)
    token = np.repeat(text, spread) * vocab.size + vocab.ids[np.repeat(begin[word], spread) + inside]
    order = np.argsort(token)
    token, weight = token[order], np.repeat(times, spread)[order]
    entropy = np.zeros(n)
    if len(token):
        head = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        count = np.add.reduceat(weight, head).astype(float)
        entropy -= np.bincount(token[head] // vocab.size, count * np.log2(count), minlength=n)
    total = np.maximum(n_tokens, 1).astype(float)
    entropy = np.log2(total) + entropy / total
    return [
        n_words, word_chars, _sums(symbol[data], offs), _lines(data, offs, spans), _repeated(words, per, text_of),
        n_tokens, n_bytes, word_chars / total, word_chars / np.maximum(n_ranked, 1), n_bytes / total,
        # Of at most log2(tokens) bits.
        np.where(n_tokens > 1, entropy / np.log2(np.maximum(total, 2.0)), 0.0), _script_of(data, offs),
    ]


def measure(docs: DataFrame, keep: Sequence[str] = ("doc_id",), pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """The columns ``keep`` and those of ``STATS`` for every row; columns of these
    names in ``keep`` are an error.

    Words are what ASCII white space divides.  A NULL or blank text has no words,
    zeros everywhere and no script.  Rows are worked on one by one, so repeated rows
    give repeated results; no rows give none.
    """
    clash = {c.lower() for c in keep} & set(STATS.names)
    if clash:
        raise ValueError(f"columns of these names are added: {sorted(clash)}")
    docs = docs.select(*keep, F.col("text").alias(free(docs.select(*keep), "_text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabularies(pieces, ranks)
        kinds = [pa.int64()] * 7 + [pa.float64()] * len(MEASURES) + [pa.string()]
        for batch in batches:
            for lo, hi, data, offs in K.runs(batch.column(len(keep))):
                made = [pa.array(x, kind) for x, kind in zip(statistics(data, offs, vocab), kinds, strict=True)]
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[:-1], *STATS.names])

    return docs.transform(small_batches).mapInArrow(run, T.StructType([*docs.schema.fields[:-1], *STATS.fields]))


def base_failed() -> Column:
    """The plain rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def size_class() -> Column:
    """Texts of 2**k to 2**(k+1) - 1 tokens are of one class, k."""
    return F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")


def bands(measured: DataFrame, group: Column, width: float = WIDTH) -> DataFrame:
    """(group, size, n, and for each measure its lowest and highest accepted value),
    from the quartiles of all rows of ``measured`` that pass the plain rules.

    Quartiles are read from counts per cell of ``CELL``, which are added up inside
    each task, so a group of any number of rows is some thousand cells, and they are
    the same on every run.  Fewer than ``LEAST_GROUP`` rows make no band.
    """
    cells = [F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) / CELL).alias("cell")) for m in MEASURES]
    counts = (
        measured.where(~base_failed())
        .select(group.alias("group"), size_class().alias("size"), F.explode(F.array(*cells)).alias("c"))
        .groupBy("group", "size", "c.measure", "c.cell").agg(F.count(F.lit(1)).alias("n"))
    )
    by = Window.partitionBy("group", "size", "measure")
    up = by.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.select("*", F.sum("n").over(up).alias("up"), F.sum("n").over(by).alias("all"))
    quartiles = placed.groupBy("group", "size", "measure").agg(
        (F.min(F.when(F.col("up") * 4 >= F.col("all"), F.col("cell"))) * CELL).alias("q1"),
        (F.min(F.when(F.col("up") * 4 >= F.col("all") * 3, F.col("cell"))) * CELL + CELL).alias("q3"),
        F.max("all").alias("n"),
    )
    floor = F.create_map(*[F.lit(x) for m in MEASURES for x in (m, FLOOR[m])])[F.col("measure")]
    reach = F.greatest((F.col("q3") - F.col("q1")) * width, floor)
    wide = quartiles.where(F.col("n") >= LEAST_GROUP).select(
        "group", "size", "n", "measure", (F.col("q1") - reach).alias("lo"), (F.col("q3") + reach).alias("hi")
    )
    of = {m: F.max(F.when(F.col("measure") == m, F.struct("lo", "hi"))).alias(m) for m in MEASURES}
    return wide.groupBy("group", "size").agg(F.max("n").alias("n"), *of.values())


def judge(measured: DataFrame, found: DataFrame, group: Column) -> DataFrame:
    """Add ``base_failed``, ``outside`` (the measures beyond their bands) and ``kept``.
    A NULL group, or one without a band, is judged by the plain rules alone.  Bands
    are counted; up to ``BROADCAST_BANDS`` of them go to every task, so that rows of
    a large group stay where they are, and beyond they are joined by group."""
    g = free(measured, "_group")
    size = free(measured, "_size")
    found = stored(found, "bands")
    if found.limit(BROADCAST_BANDS + 1).count() <= BROADCAST_BANDS:
        found = F.broadcast(found)
    ends = [F.col(m).alias(f"{g}{m}") for m in MEASURES]
    right = found.select(F.col("group").alias(g), F.col("size").alias(size), *ends)
    joined = measured.join(right, (group == F.col(g)) & (size_class() == F.col(size)), "left")
    beyond = [
        F.when((F.col(m) < F.col(f"{g}{m}.lo")) | (F.col(m) > F.col(f"{g}{m}.hi")), F.lit(m)) for m in MEASURES
    ]
    out = joined.withColumn("base_failed", base_failed()).withColumn("outside", F.array_compact(F.array(*beyond)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0)).select(
        *measured.columns, "base_failed", "outside", "kept"
    )


def rules(docs: DataFrame, keep: Sequence[str] = ("doc_id",), lang: str = "lang") -> DataFrame:
    """Measure, band and judge all documents; groups are ``lang``, or the script where it is NULL."""
    names = [*keep, *([lang] if lang not in keep else [])]
    measured = stored(measure(docs, names), "fertility")
    group = F.coalesce(F.col(lang).cast("string"), F.col("script"))
    return judge(measured, bands(measured, group), group).select(*keep, *STATS.names, "base_failed", "outside", "kept")
