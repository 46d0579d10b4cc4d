"""Periodic runs against every period tried at every place."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetboard.llm import periodic

from .test_llm import SCHEMA, awkward


def brute(w: list) -> list[tuple[int, int, int]]:
    found: dict = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e, q) for (s, e), q in found.items())


def test_transform_is_its_inverse_and_correlates():
    rng = np.random.default_rng(3)
    x = rng.integers(0, periodic.MODULUS, (5, 32), dtype=np.uint64)
    assert (periodic.transform_back(periodic.transform(x)) == x).all()
    for b in (1, 2, 8):
        block, window = rng.integers(0, 900, (4, b), dtype=np.uint64), rng.integers(0, 900, (4, 2 * b - 1), dtype=np.uint64)
        got = periodic.differences(block, window)
        for r in range(4):
            for d in range(b):
                want = sum((int(p) - int(q)) ** 2 for p, q in zip(block[r], window[r, d : d + b], strict=True))
                assert int(got[r, d]) == want


@pytest.mark.parametrize("widest", [2, 1 << 15])
def test_runs_against_brute_force(monkeypatch, widest):
    monkeypatch.setattr(periodic, "WIDEST", widest)
    r = random.Random(widest)
    for _ in range(400):
        texts = []
        for _ in range(r.randint(1, 4)):
            k = r.choice([1, 2, 2, 3, 5, 50])
            w = [r.randrange(k) for _ in range(r.choice([0, 1, 5, 6, 7, 30, 90]))]
            if r.random() < 0.7:
                i = r.randrange(len(w) + 1)
                w[i:i] = [r.randrange(k) for _ in range(r.randint(1, 9))] * r.randint(2, 9)
            texts.append(w)
        offs = np.cumsum([0, *map(len, texts)])
        codes = np.array([1000 * i + x for i, w in enumerate(texts) for x in w], dtype=np.int64)
        want = sorted((s + o, e + o, q) for o, w in zip(offs, texts, strict=False) for s, e, q in brute(w))
        assert sorted(map(tuple, periodic.runs_of(codes, offs).tolist())) == want


def test_one_long_repetition_is_quick():
    for q in (1, 2, 700):
        n = 200_000
        assert periodic.runs_of(np.arange(n) % q, np.array([0, n])).tolist() == [[0, n, q]]


def test_find_runs_of_awkward_rows(spark):
    rows = [*awkward(), (50, "a b " * 7 + "c " + "d\t" * 9, "en", "s", 3, 0.1, "c", 3), (51, "a " * 6, "en", "s", 3, 0.1, "c", 3)]
    # Columns of the new names are replaced; others, whatever they are called, stay.
    docs = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", runs int")
    got = periodic.find_runs(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        words = (r["text"] or "").encode().split()
        want = brute(words)
        assert [(x["start"], x["start"] + x["length"], x["period"]) for x in r["runs"]] == want
        gone = {i for s, e, q in want for i in range(s + q, e)}
        assert r["collapsed"].encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert r["n_words"] == len(words)
    by = {r["doc_id"]: r for r in got}
    assert by[50]["collapsed"] == "a b c d" and by[50]["_doc"] == "c"
    best = periodic.longest_run(F.col("runs")).alias("b")
    top = {r["doc_id"]: r["b"] for r in periodic.find_runs(docs).select("doc_id", best).collect()}
    assert tuple(top[50]) == (0, 14, 2) and top[4] is None
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_repeated_tails(spark):
    import zlib

    rows = [(i, " ".join(f"w{k}" for k in range(i % 90))) for i in range(400)] + [(None, "a b"), (10**12, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _w")
    got = {r["doc_id"]: r["text"] for r in periodic.with_repeated_tails(docs).collect()}
    changed = 0
    for i, t in rows:
        words = (t or "").split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
            assert got[i].split() == want
            changed += want != words
        else:
            assert got[i] == t
    assert changed > 10
