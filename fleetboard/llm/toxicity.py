"""Toxicity of texts that may be disguised.

A noisy channel may have put look-alike digits and signs for letters, repeated
letters, or set separators between them.  Every token that shows such traces is
decoded by Viterbi over the lattice of its possible letters, under a trigram
model of letters counted over all documents.  The restored words are then
scored with the others: word stems whose presence goes with the label, found by
a likelihood-ratio test on labelled rows, give the probability together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import bounded_sample, small_batches

SAMPLE = 20_000  # labelled rows that the stems are learned from at most
MOST_STEMS = 5_000  # size of the lexicon, the strongest stems first
SURE = 0.9  # share of a stem's documents that must carry the label
STEMS = (4, 5, 6)  # bytes of a word's start that are its features
LETTERS = 64  # codes of the letter model: 0 is a word's edge
KEPT = 1 << 20  # characters of decoded tokens that a task remembers
# What a sign may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
SEPARATORS = ".-_*~'/ "
COST = {"swap": 0.5, "drop": 1.0, "keep": 0.0, "separator": 0.2}  # negative log probabilities of the channel


def letter_code(ch: str) -> int:
    """1 to 26 for a to z; other letters share the codes above by their number."""
    o = ord(ch)
    if 97 <= o <= 122:
        return o - 96
    return 27 + o % (LETTERS - 27)


_CODE_OF_BYTE = np.zeros(256, dtype=np.int64)
_CODE_OF_BYTE[97:123] = np.arange(1, 27)


def count_letters(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of letters in words, over every whole text.

    Tasks send their own counts, which are added by key; the table has
    ``LETTERS`` cubed cells whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, dtype=np.int64)
        table = _code_table()
        for batch in batches:
            lower = K.lower_text(batch.column(0))
            for lo, hi, _, _ in K.runs(lower, 1 << 20):
                joined = "\n".join(lower.slice(lo, hi - lo).to_pylist()) + "\n"
                code = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].astype(np.int64)
                code = np.concatenate(([0], code))
                b = code[1:]
                # At a word's start the letter before the edge does not count.
                a = np.where(code[:-1] == 0, 0, np.concatenate(([0], code[:-2])))
                three = (a * LETTERS + code[:-1]) * LETTERS + b
                total += np.bincount(three[(code[:-1] > 0) | (b > 0)], minlength=LETTERS**3)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    counts = docs.select(text).transform(small_batches).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()  # LETTERS cubed rows at most
    out = np.zeros(LETTERS**3)
    out[rows["cell"].to_numpy(dtype=int)] = rows["n"].to_numpy(dtype=float)
    return out.reshape(LETTERS, LETTERS, LETTERS)


@lru_cache(maxsize=1)
def _code_table() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for o in range(0x110000):
        if chr(o).isalpha():
            table[o] = letter_code(chr(o))
    return table


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), mixed from trigrams, bigrams and single letters."""
    two, one = counts.sum(axis=0), counts.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + LETTERS)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (counts + 5 * p2[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


# A text from its last letter back: what is before it, that letter, the length.
# Texts that go on from the same one share it, so a step costs the same however long they are.
_Text = tuple["_Text | None", str, int]


def _before(one: _Text, two: _Text) -> bool:
    """Whether text ``one`` sorts before ``two``; only the letters after what they share are read."""
    shorter = one[2] < two[2]
    while one[2] > two[2]:
        one = one[0]
    while two[2] > one[2]:
        two = two[0]
    while one is not two:
        if one[1] != two[1]:
            shorter = one[1] < two[1]
        one, two = one[0], two[0]
    return shorter


def decode(token: str, lm: np.ndarray) -> str:
    """The likeliest letters behind a token.

    Each character is a letter kept, a look-alike swapped for what it may stand
    for, a separator dropped, or a repeat of the letter before it, kept or
    dropped.  Ties go to the text that sorts first.  Time and memory grow with
    the token's length, which has no bound.
    """
    # (two letter codes, last letter) -> (cost, text)
    states: dict[tuple[int, int, str], tuple[float, _Text]] = {(0, 0, ""): (0.0, (None, "", 0))}
    for ch in token:
        options = [(c, COST["swap"]) for c in LOOKALIKES.get(ch, "")]
        if ch.isalpha():
            options.append((ch, COST["keep"]))
        nxt: dict[tuple[int, int, str], tuple[float, _Text]] = {}
        for (a, b, last), (cost, text) in states.items():
            moves = [
                ((b, letter_code(c), c), cost + extra - float(lm[a, b, letter_code(c)]), (text, c, text[2] + 1))
                for c, extra in options
            ]
            if any(c == last for c, _ in options):
                moves.append(((a, b, last), cost + COST["drop"], text))
            if ch in SEPARATORS or not options:
                moves.append(((a, b, last), cost + COST["separator"], text))
            for state, total, word in moves:
                old = nxt.get(state)
                if old is None or total < old[0] or total == old[0] and _before(word, old[1]):
                    nxt[state] = (total, word)
        states = nxt
    ends = [(cost - float(lm[a, b, 0]), text) for (a, b, _), (cost, text) in states.items()]
    least = min(cost for cost, _ in ends)
    return min(_spelled(text) for cost, text in ends if cost == least)


def _spelled(text: _Text) -> str:
    letters = []
    while text[0] is not None:
        letters.append(text[1])
        text = text[0]
    return "".join(reversed(letters))


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars if ord(c) < 128]] = True
    return out


_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_SIGN = _flags("".join(LOOKALIKES)) | _flags(SEPARATORS.strip())
_EDGE = ".,;:!?\"'()[]{}*#%&|-_~/"


def suspects(data: np.ndarray, offs: np.ndarray) -> list[tuple[int, str]]:
    """(text, token) of what shows traces of a disguise in lower-case texts: signs
    among letters, a letter three times, or four and more letters set apart.
    Tokens and rows of letters are taken whole, however long."""
    start, end, per = K.word_spans(data, offs)
    if not len(start):
        return []
    n = len(data)
    letter = _LETTER[data]
    sums = np.concatenate(([0], np.cumsum(letter)))
    letters = sums[end] - sums[start]
    # A sign or digit with a letter on one side and more of the token on the other.
    inner = np.zeros(n, dtype=bool)
    inner[1:-1] = _SIGN[data[1:-1]] & (letter[:-2] | letter[2:])
    edge = np.zeros(n, dtype=bool)
    edge[end - 1] = True
    inner &= ~(edge & ~_flags("0123456789@$")[data])
    thrice = np.zeros(n, dtype=bool)
    thrice[2:] = letter[2:] & (data[2:] < 128) & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    marks = np.concatenate(([0], np.cumsum(inner | thrice)))
    size = end - start
    odd = (marks[end] > marks[start]) & (letters > 0) & (size >= 3)
    text_of = np.repeat(np.arange(len(offs) - 1), np.diff(per))
    out = []
    for i in np.flatnonzero(odd):
        word = bytes(data[start[i] : end[i]]).decode("utf-8", "replace")
        core = word.strip(_EDGE)
        stop = len(core)
        while stop > 2 and core[stop - 1] == core[stop - 2] and core[stop - 1] in "$@+":
            sign = core[stop - 1]
            while stop and core[stop - 1] == sign:
                stop -= 1
        core = core[:stop]
        plain = sum(c.isalpha() for c in core)
        if core.isalpha() and not any(core[k] == core[k + 1] == core[k + 2] for k in range(len(core) - 2)):
            continue
        if plain and 3 * plain >= len(core):
            out.append((int(text_of[i]), core))
    # Single characters in a row.
    single = (size <= 2) & (letters == size) & ((size == 1) | (data[start] >= 0xC0)) | (size == 1) & _SIGN[data[start]]
    single &= size <= 2
    run_start = np.flatnonzero(single & ~np.concatenate(([False], single[:-1] & (text_of[1:] == text_of[:-1]))))
    run_end = np.flatnonzero(single & ~np.concatenate((single[1:] & (text_of[1:] == text_of[:-1]), [False]))) + 1
    for a, b in zip(run_start, run_end, strict=True):
        if b - a < 4:
            continue
        chars = bytes(data[start[a] : end[b - 1]]).decode("utf-8", "replace").split()
        out.append((int(text_of[a]), "".join(chars)))
    return out


@dataclass(frozen=True)
class Lexicon:
    """Stem hashes in order, the probability that each brings, and that without any."""

    stems: np.ndarray
    risk: np.ndarray
    rest: float


class Reader:
    """Stem features of texts, restored words included; keeps decoded tokens."""

    def __init__(self, lm: np.ndarray):
        self.lm = lm
        self.known: dict[str, str] = {}
        self.size = 0

    def restored(self, token: str) -> str:
        word = self.known.get(token)
        if word is None:
            word = decode(token, self.lm)
            if self.size + len(token) > KEPT:
                self.known.clear()
                self.size = 0
            if len(token) <= KEPT:
                self.known[token] = word
                self.size += len(token)
        return word

    def features(self, lower: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, stem) pairs of lower-case texts, a run of texts at a time."""
        for lo, hi, data, offs in K.runs(lower):
            owners, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for own, d, o in ((np.arange(lo, hi), data, offs), self._decoded(lo, data, offs)):
                if not len(d):
                    continue
                start, end, text_of = _letter_runs(d, o)
                spans = K.Spans(d)
                for size in STEMS:
                    parts.append(spans(start, np.minimum(end, start + size)))
                    owners.append(own[text_of])
            yield np.concatenate(owners), np.concatenate(parts)

    def _decoded(self, lo: int, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [(t + lo, self.restored(w).encode("utf-8", "replace")) for t, w in suspects(data, offs)]
        raw = b"".join(w for _, w in found)
        ends = np.cumsum([0, *(len(w) for _, w in found)])
        return np.array([t for t, _ in found], dtype=np.int64), np.frombuffer(raw, dtype=np.uint8), ends


def _letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters, and the text of each."""
    letter = _LETTER[data]
    full = offs[:-1] < offs[1:]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    at = offs[:-1][full]
    first[at] = letter[at]
    at = offs[1:][full] - 1
    last[at] = letter[at]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(offs, start, side="right") - 1


def _distinct(owner: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((stem, owner))
    owner, stem = owner[order], stem[order]
    if len(owner):
        keep = np.concatenate(([True], (owner[1:] != owner[:-1]) | (stem[1:] != stem[:-1])))
        return owner[keep], stem[keep]
    return owner, stem


def learn(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, lm: np.ndarray, sample: int = SAMPLE
) -> Lexicon:
    """The stems whose presence goes with the label, from ``sample`` labelled rows at most.

    A stem counts if its likelihood ratio stands out among as many trials as there are
    rows.  No labelled row, or none of one kind, leaves the lexicon empty.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed)
    known = known.groupBy("doc_id").agg(F.max(label).cast("long").alias("_y"))
    some = bounded_sample(known, "doc_id", sample)  # 16 bytes a row, under a megabyte by ``sample``
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "_y")
    counted = texts.groupBy("_y").count().collect()
    n = {r["_y"]: r["count"] for r in counted}
    total, bad = sum(n.values()), n.get(1, 0)
    share = (bad + 0.5) / (total + 1)
    empty = Lexicon(np.zeros(0, np.uint64), np.zeros(0), share)
    if not bad or bad == total:
        return empty

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lm)
        for batch in batches:
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            for owner, stem in reader.features(K.lower_text(batch.column("text"))):
                owner, stem = _distinct(owner, stem)
                stems, at = np.unique(stem, return_inverse=True)
                pos = np.bincount(at, y[owner] == 1, len(stems)).astype(np.int64)
                allof = np.bincount(at, minlength=len(stems))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(stems.view(np.int64)), pa.array(pos), pa.array(allof)], ["stem", "pos", "n"]
                )

    stems = texts.transform(small_batches).mapInArrow(run, "stem long, pos long, n long").groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    pos, seen = F.col("pos").cast("double"), F.col("n").cast("double")
    rate = (pos / seen).cast("double")
    ratio = 2 * (
        pos * F.log(rate / share) + F.when(seen > pos, (seen - pos) * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    )
    strict = 6 + 2 * math.log(max(total, 2))
    strong = stems.where((pos > 0) & (rate > max(SURE, share)) & (ratio > strict))
    rows = strong.orderBy(ratio.desc(), "stem").limit(MOST_STEMS).toPandas()
    if not len(rows):
        return empty
    key = rows["stem"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(key)
    p = (rows["pos"].to_numpy(float) + share) / (rows["n"].to_numpy(float) + 1)
    return Lexicon(key[order], p[order], share * 0.1)


def scorer(lexicon: Lexicon, lm: np.ndarray) -> Callable[[pa.Array], np.ndarray]:
    """A function from a column of texts to scores; NULL and empty texts score the rest."""
    reader = Reader(lm)
    quick = np.zeros(1 << 20, dtype=bool)
    quick[(lexicon.stems >> np.uint64(44)).astype(np.int64)] = True

    def score(text: pa.Array) -> np.ndarray:
        n = len(text)
        safe = np.zeros(n)
        for owner, stem in reader.features(K.lower_text(text)):
            maybe = np.flatnonzero(quick[(stem >> np.uint64(44)).astype(np.int64)])
            if not len(maybe):
                continue
            owner, stem = owner[maybe], stem[maybe]
            at = np.minimum(np.searchsorted(lexicon.stems, stem), len(lexicon.stems) - 1)
            hit = lexicon.stems[at] == stem
            pair = np.unique(np.column_stack((owner[hit], at[hit])), axis=0)
            safe += np.bincount(pair[:, 0], np.log1p(-np.minimum(lexicon.risk[pair[:, 1]], 1 - 1e-9)), n)
        return 1 - (1 - lexicon.rest) * np.exp(safe)

    return score


def score(docs: DataFrame, lexicon: Lexicon, lm: np.ndarray, out: str = "score") -> DataFrame:
    """Add the score of every whole text to the other columns; a column of the
    name ``out`` is replaced."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, lm))  # a megabyte and MOST_STEMS stems at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = scorer(*shared.value)
        for batch in batches:
            columns = [*batch.columns, pa.array(values(batch.column("text")))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.transform(small_batches).mapInArrow(run, schema)
