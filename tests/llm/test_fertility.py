"""Fertility measures and bands against one document at a time."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetboard.llm import fertility as Q
from fleetboard.llm import queries

from .test_llm import SCHEMA, awkward, prose


def plain(text: str | None) -> dict:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again),
        "base_failed": len(words) < 20 or 100 * len(again) > 30 * len(words),
    }


def tokens_of(text: str | None) -> tuple[list[int], int]:
    vocab = Q.vocabularies(Q.PIECES, Q.RANKS)
    found = vocab.encode(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return [i for ids, _ in found for i in ids], sum(n for _, n in found)


ROWS = [
    *[r[:2] for r in awkward()], (30, "x y z\nx y z\n x y z\n\nx y z"), (31, "a b c d e f g h " * 5 + "tail"), (32, "\n"), (33, "# $ <|> 𝒳𝓨"),
    (34, "Это обычный текст, и он записан кириллицей " * 3), (35, "w" * 3000 + " " + "ж" * 1200), (36, "one two three four five six seven eight nine " * 2),
]


@pytest.mark.parametrize("limit", [300, 2_000_000])
def test_measures_against_one_text_at_a_time(spark, monkeypatch, limit):
    from fleetboard.llm import kernels as K

    monkeypatch.setattr(K.runs, "__defaults__", (limit,))
    import pyarrow as pa

    texts = [t for _, t in ROWS]
    for lo, hi, data, offs in K.runs(pa.array(texts)):
        made = dict(zip(Q.STATS.names, Q.statistics(data, offs, Q.vocabularies(Q.PIECES, Q.RANKS)), strict=True))
        for i, text in enumerate(texts[lo:hi]):
            want = plain(text)
            assert {k: int(made[k][i]) for k in want if k != "base_failed"} == {k: v for k, v in want.items() if k != "base_failed"}
            ids, ranked = tokens_of(text)
            assert made["n_tokens"][i] == len(ids)
            n = max(len(ids), 1)
            assert made["piece_chars"][i] == pytest.approx(want["word_chars"] / n)
            assert made["rank_chars"][i] == pytest.approx(want["word_chars"] / max(ranked, 1))
            entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
            assert made["entropy"][i] == pytest.approx(entropy / math.log2(n) if n > 1 else 0, abs=1e-9)
    assert Q._script_of(*one("Это"))[0] == "cyrillic" and Q._script_of(*one("12 !"))[0] is None


def one(text: str):
    import numpy as np

    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return raw, np.array([0, len(raw)])


def test_byte_fallback_is_seen():
    data, offs = one(" word")
    made = dict(zip(Q.STATS.names, Q.statistics(data, offs, Q.vocabularies(Q.PIECES, Q.RANKS)), strict=True))
    assert made["n_byte_tokens"][0] == 6


def test_bands_against_sorted_values(spark):
    rows = [(i, "en" if i % 2 else None, prose(60 + i % 40, i)) for i in range(400)] + [(900 + i, "en", prose(60, i).replace(" ", " | ")) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    measured = Q.measure(docs, ["doc_id", "lang"]).cache()
    group = F.coalesce("lang", "script")
    got = {(r["group"], r["size"]): r for r in Q.bands(measured, group).collect()}
    by: dict = {}
    for r in measured.collect():
        if not (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]):
            by.setdefault((r["lang"] or r["script"], int(math.log2(r["n_tokens"]))), []).append(r)
    assert set(got) == {k for k, v in by.items() if len(v) >= Q.LEAST_GROUP} and got
    for key, band in got.items():
        assert band["n"] == len(by[key])
        for m in Q.MEASURES:
            cells = sorted(math.floor(r[m] / Q.CELL) for r in by[key])
            n = len(cells)
            q1, q3 = cells[-(-n // 4) - 1] * Q.CELL, (cells[-(-3 * n // 4) - 1] + 1) * Q.CELL
            reach = max((q3 - q1) * Q.WIDTH, Q.FLOOR[m])
            assert (band[m]["lo"], band[m]["hi"]) == pytest.approx((q1 - reach, q3 + reach))
    judged = {r["doc_id"]: r for r in Q.judge(measured, Q.bands(measured, group), group).collect()}
    assert len(judged) == len(rows)
    assert sum(judged[i]["kept"] for i in range(400)) > 390 and not any(judged[900 + i]["kept"] for i in range(8))
    for r in judged.values():
        band = got.get((r["lang"] or r["script"], int(math.log2(max(r["n_tokens"], 1)))))
        outside = [m for m in Q.MEASURES if band and not band[m]["lo"] <= r[m] <= band[m]["hi"]]
        assert r["outside"] == outside and r["kept"] == (not r["base_failed"] and not outside)


def test_rules_on_awkward_rows(spark):
    extra = [(i, t, None, None, None, None, None, None) for i, t in ROWS if i is not None and i >= 30]
    docs = spark.createDataFrame([(*r, 1, "k") for r in [*awkward(), *extra]], SCHEMA + ", size int, group string")
    got = Q.rules(docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in [*awkward(), *extra])
    texts = dict(ROWS)
    for r in got:
        if r["doc_id"] is not None:
            want = plain(texts[r["doc_id"]])
            assert {k: r[k] for k in want} == want and not (r["base_failed"] and r["kept"])
    assert Q.rules(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Q.measure(docs.withColumn("entropy", F.lit(1)), ["doc_id", "entropy"])


def test_query_against_the_plain_rules(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op13_fertility(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        want = plain(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want and r["kept"] == (not r["base_failed"] and not r["outside"])
