"""Spelling variants against all pairs."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import regex

from fleetboard.llm import spelling

from .test_llm import SCHEMA, awkward


def within_one(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts: dict[str, int], times: int = 10) -> dict:
    near = {w: [x for x in counts if within_one(w, x)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def random_words(seed: int) -> dict[str, int]:
    r = random.Random(seed)
    words: dict[str, int] = {}
    for _ in range(60):
        w = "".join(r.choice("abcdeéxyzÿ×") for _ in range(r.randint(1, 9)))
        words[w] = r.choice([1, 2, 30, 500, 9000])
        for _ in range(r.randint(0, 6)):
            k = r.randrange(len(w))
            v = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abé") + w[k:], w[:k] + r.choice("abé") + w[k + 1 :]])
            if v:
                words[v] = r.choice([1, 1, 3, 40, 700])
                w = r.choice([w, v])
    return words


def test_variants_against_all_pairs(spark):
    words = {f"{k}": v for seed in range(4) for k, v in random_words(seed).items()}
    # Words of one letter repeated, ties of forms, and a way of three steps.
    words |= {"a" * n: 10**n for n in range(1, 9)} | {"longer" * 400: 5, "longer" * 400 + "s": 70}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute(words)
    assert len(got) == len(words)


def test_words_are_counted_with_slips(spark):
    rows = [(r[0], r[1]) for r in awkward()] + [(100 + i, f"Straßen ÄPFELBAUM×÷ wörterbuch{i % 3} Anderswo-anderswo {'ab' * 300}") for i in range(150)]
    # The same rows with columns of clashing names.
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string")
    expected: Counter = Counter()
    for i, t in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 5 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                expected[w] += 1
    got = {r["word"]: r["n"] for r in spelling.count_words(docs, slip=5).collect()}
    assert got == dict(expected)
    full = spelling.group_variants(docs, slip=5).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in full} == brute({w: n for w, n in expected.items() if n >= 2})
    assert spelling.group_variants(docs.limit(0)).count() == 0


def test_neighbourhoods_meet(monkeypatch):
    """Keys made in small steps are those made at once, and words at one edit share one."""
    r = random.Random(2)
    for _ in range(200):
        a = "".join(r.choice("abcdefgé") for _ in range(r.randint(2, 12)))
        k = r.randrange(len(a))
        b = r.choice([a[:k] + a[k + 1 :], a[:k] + "z" + a[k:], a[:k] + "q" + a[k + 1 :]])
        words = spelling._Reduced([a, "zz", b])
        own = words.own()
        total = int(words.end[-1])
        of, keys = words.neighbours(0, total)
        steps = [words.neighbours(i, min(i + 3, total)) for i in range(0, total, 3)]
        assert sorted(zip(of, keys, strict=True)) == sorted((w, k) for o, ks in steps for w, k in zip(o, ks, strict=True))
        met = {(int(w), int(key)) for w, key in zip(of, keys, strict=True)}
        assert own[0] == own[2] or (0, int(own[2])) in met or (2, int(own[0])) in met
