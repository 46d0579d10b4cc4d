"""The operators on small tables with every awkward row, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import checks.compare as compare
from fleetboard.llm import (
    chunking, contamination, graph, language, lines, near, pieces, quality, queries, ring, tokens, toxicity,
)
from fleetboard.llm import kernels as K

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _doc string, shard int"
rng = random.Random(5)
WORDS = ["alpha", "beta", "gamma", "delta", "öl", "the", "of", "and", "run", "sea", "stone", "wind", "leaf", "iron", "glass"]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    words = [r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


def awkward() -> list[tuple]:
    base = prose(80, 1)
    texts = [
        base, base, base.replace("alpha", "alphb", 1), prose(60, 2) + "\n" + base.split("\n")[0], None, "", " \n\t ", "one",
        "one two", "\n\n", "x" * 30_000, prose(4000, 3), "Ünïcödé 🙂 é́ ▁ \x00 end", prose(70, 4), "a b c d e", "A  B c D e",
    ]
    rows = [(i, t, "en" if i % 3 else "de", "s", None if t is None else len(t), 0.5, "c", 3) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, prose(50, 6), None, None, None, None, None, None), (None, base, None, None, 3, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def shingle_set(text: str | None, n: int = 5) -> set:
    w = words_of(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


# -- 1


def test_fingerprints_follow_the_contract(docs, none):
    got = chunking.compare_with_next(docs, 4).collect()
    rows = sorted(((i, t or "") for i, t, *_ in awkward() if i is not None), reverse=True)
    assert len(got) == len(awkward())
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] not in (None, 0)}
    for (i, t), (_, nxt) in zip(rows, rows[1:], strict=False):
        if i in by_id:
            half = len(t) // 2
            edited = t[: len(t) - half] + nxt[:half]
            assert by_id[i]["n_chars"] == len(t)
            assert by_id[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert by_id[1]["fingerprint"] == next(r for r in got if r["doc_id"] == 0)["fingerprint"]
    assert chunking.compare_with_next(none, 4).count() == 0
    assert chunking.fingerprint(docs).columns[-1] == "fingerprint"
    assert chunking.fingerprint(none).count() == 0


def test_chunks_cover_the_text_and_resist_shifts():
    text = prose(3000, 9)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    start, end, _ = chunking.chunks(raw, np.array([0, len(raw)]))
    assert start[0] == 0 and end[-1] == len(raw) and (start[1:] == end[:-1]).all()
    a, b = chunking._prints([text, "put in front " + text[:5000] + "inside" + text[5000:]])
    assert chunking.containment(a, b) > 0.9
    assert chunking.containment(a, a) == 1
    assert (chunking.from_string(chunking.as_string(a)) == a).all()


# -- 2


def test_pieces_decode_to_the_text_and_repeat(docs, none):
    rows = pieces.encode(docs)
    back = {(r["doc_id"], r["text"]): (r["decoded"], r["pieces"]) for r in pieces.decode(rows).collect()}
    for i, t, *_ in awkward():
        assert back[i, t][0] == t
    again = {(r["doc_id"], r["text"]): r["pieces"] for r in pieces.encode(docs.repartition(7)).collect()}
    assert all(again[k] == v[1] for k, v in back.items())
    other = {(r["doc_id"], r["text"]): r["pieces"] for r in pieces.encode(docs, seed=1).collect()}
    assert other[11, back_text(11)] != again[11, back_text(11)]
    assert pieces.decode(pieces.encode(none)).count() == 0


def back_text(i: int):
    return awkward()[i][1]


def test_pieces_are_drawn_by_their_weights():
    """Frequencies of the segmentations of one word against all its paths."""
    m = pieces.model(pieces.MODEL)
    word, n = b"the", 4000
    ids, offs = m.encode([word] * n, pieces.row_keys(list(range(n)), 3))
    seen: dict = {}
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        key = tuple(ids[a:b].tolist())
        seen[key] = seen.get(key, 0) + 1
    raw = b"\xff" + word
    table = {}
    for i in range(len(m.size)):
        if m.size[i]:
            table.setdefault(m.raw[m.at[i] : m.at[i] + m.size[i]].tobytes().replace(b" ", b"\xff"), i)
    paths: dict = {}

    def walk(at: int, path: tuple, logw: float) -> None:
        if at == len(raw):
            paths[path] = np.exp(logw)
        for end in range(at + 1, len(raw) + 1):
            i = table.get(raw[at:end])
            if i is not None and not (3 <= i <= 258):
                walk(end, (*path, i), logw + m.weight[i])

    walk(0, (), 0.0)
    total = sum(paths.values())
    assert set(seen) <= set(paths)
    for path, w in paths.items():
        if w / total > 0.02:
            assert abs(seen.get(path, 0) / n - w / total) < 0.03


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_pieces_are_lossless(texts):
    m = pieces.model(pieces.MODEL)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ids, offs = m.encode(raw, pieces.row_keys(list(range(len(raw))), 1))
    assert m.decode(ids, offs) == raw


# -- 3


def near_brute(rows: list[tuple[int | None, str | None]]):
    texts = sorted({t or "" for _, t in rows})
    sets = {t: shingle_set(t) for t in texts}
    link = {t: {u for u in texts if u != t and sets[t] and sets[u] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])} for t in texts}
    group = {t: t for t in texts}
    for _ in texts:
        for t in texts:
            low = min([group[t], *(group[u] for u in link[t])])
            group[t] = low
    return link, group


def test_near_copies_against_all_pairs(docs, none):
    rows = [(r[0], r[1]) for r in awkward()]
    link, group = near_brute(rows)
    got = near.near_classes(docs).collect()
    head = {}
    for i, t in rows:
        g = group[t or ""]
        if i is not None:
            head[g] = min(i, head.get(g, i))
    expected = sorted((str(i), str(head.get(group[t or ""])), len(link[t or ""])) for i, t in rows)
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["links"]) for r in got) == expected
    kept = near.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((group[r["text"] or ""]) for r in kept.collect()) == sorted(set(group.values()))
    assert near.near_classes(none).count() == 0 and near.keep_one(none).count() == 0


def test_a_large_group_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_TEXTS", 4)
    words = prose(150, 20).split()
    rows = []
    for i in range(30):
        w = list(words)
        for k in range(i % 4):
            w[(7 * i + 31 * k) % len(w)] = f"new{i}x{k}"
        rows.append((i, " ".join(w)))
    link, group = near_brute(rows)
    got = {r["doc_id"]: r for r in near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: got[i]["links"] for i, _ in rows} == {i: len(link[t]) for i, t in rows}


def test_a_chain_of_false_candidates(spark, monkeypatch):
    """Texts that share two thirds of their shingles with the next one, and so on:
    they meet in bands but are not near, and no task holds more than neighbours."""
    monkeypatch.setattr(near, "BLOCK_TEXTS", 4)
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(words[i * 20 : i * 20 + 104])) for i in range(150)]
    # Some near copies of links of the chain.
    rows += [(1000 + i, rows[i * 30][1] + " more") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    link, _ = near_brute(rows)
    got = {r["doc_id"]: r for r in near.near_classes(docs).collect()}
    assert {i: got[i]["links"] for i, _ in rows} == {i: len(link[t]) for i, t in rows}
    bands, per = near.banding(0.8)
    slim = docs.selectExpr("doc_id as _doc", "xxhash64(text) as _th", "text as _text")
    signed = near.signatures(slim, 5, bands, per)
    classes = signed.selectExpr("_id", "struct(false as none, _doc, _th) as _first", "_n", "_bands")
    members, tasks = near._meetings(classes)
    assert members.count() > 140
    assert tasks.count() < 12 * members.count()


def test_banding_reaches_its_recall():
    bands, rows = near.banding(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= near.RECALL and bands * rows <= near.MOST_HASHES


def test_components(spark):
    edges = [(f"{i + 1:03}", f"{i:03}") for i in range(40) if i % 10] + [("900", "900")]
    got = {r["a"]: r["b"] for r in graph.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    # 1-10, 11-20, 21-30 and 31-40 are chains.
    assert got == {f"{i:03}": f"{(i - 1) // 10 * 10 + 1:03}" for i in range(1, 41) if (i - 1) % 10}


# -- 4


@pytest.mark.parametrize("factor", [1.0, 1.25])
def test_ring_balance_and_slots(docs, none, factor):
    got = ring.shard(docs, "doc_id", shards=5, vnodes=8, load_factor=factor, cell_rows=2).collect()
    per: dict = {}
    for r in got:
        per.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, per.values())) == len(awkward())
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    caps = ring.capacities(len(awkward()), 5, factor)
    assert all(len(per.get(s, [])) <= caps[s] for s in range(5))
    assert ring.shard(none, "doc_id").count() == 0


def walked(arcs: list[int], owners: tuple[int, ...], caps: list[int]) -> list[list[int]]:
    """Rows placed one at a time: in rounds of the ring's order each goes to the
    shard of its point, or on to the next point clockwise whose shard has room."""
    room, got = list(caps), [[0] * len(caps) for _ in owners]
    waiting = [(a, a) for a, n in enumerate(arcs) for _ in range(n)]
    while waiting:
        refused = []
        for at, arc in sorted(waiting):
            if room[owners[at]]:
                room[owners[at]] -= 1
                got[arc][owners[at]] += 1
            else:
                refused.append((at, arc))
        waiting = []
        for at, arc in refused:
            while not room[owners[at]]:
                at = (at + 1) % len(owners)
            waiting.append((at, arc))
    return got


def test_ring_places_like_one_row_at_a_time():
    r = random.Random(8)
    for _ in range(60):
        shards = r.randint(1, 5)
        ring_ = ring.Ring.of(shards, r.randint(1, 6))
        counts = [r.choice([0, 1, 4, 30]) for _ in ring_.points]
        caps = ring.capacities(sum(counts), shards, r.choice([1.0, 1.3]))
        placed = ring.place(counts, ring_.owners, caps)
        got = [[0] * shards for _ in ring_.points]
        used = [0] * shards
        for arc, lo, hi, s, slot in sorted(placed, key=lambda p: (p[3], p[4])):
            got[arc][s] += hi - lo
            assert slot == used[s]
            used[s] += hi - lo
        assert got == walked(counts, ring_.owners, caps)
        assert all(u <= c for u, c in zip(used, caps, strict=True))


def test_ring_keeps_columns_of_any_name(spark):
    names = ["_n", "_arc", "_cell", "_pos", "_lo", "_slot", "_b", "_at", "_ring_pos", "_ring_rank", "_ring_lo", "count", "SHARD"]
    rows = [(i % 40, *[f"{c}{i}" for c in names]) for i in range(300)] + [(None, *["x"] * len(names))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"`{c}` string" for c in names))
    got = ring.shard(docs, "doc_id", shards=3, cell_rows=10)
    left = names[:-1]
    assert got.columns == ["doc_id", *left, "home_shard", "shard", "slot"]
    assert sorted(map(str, (tuple(r)[: len(left) + 1] for r in got.collect()))) == sorted(str(r[:-1]) for r in rows)


@pytest.mark.parametrize(("factor", "most"), [(1.0, 0.35), (1.25, 0.3)])
def test_ring_moves_little_when_it_grows(spark, factor, most):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    a = {r["doc_id"]: r["shard"] for r in ring.shard(ids, "doc_id", 16, load_factor=factor).collect()}
    b = {r["doc_id"]: r["shard"] for r in ring.shard(ids, "doc_id", 17, load_factor=factor).collect()}
    moved = sum(a[i] != b[i] for i in a) / len(a)
    print(f"moved from 16 to 17 shards at {factor}: {moved:.3f}")
    assert 1 / 17 - 0.02 < moved < most


def test_ring_query_reports_sizes(spark, sf_dir):
    got = queries.op4_ring(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))


# -- 5


def test_token_counts_after_random_edits():
    enc = tokens.encoder(tokens.VOCABULARY)
    signs = ["a", "b", " ", "  ", "\n", "'", "re", "1", "é", "!!", ".", "word", "'s", "🙂"]
    for _ in range(300):
        text = "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 40, 900])))
        cut = enc.cut(text)
        tree = tokens.Tree([len(p) for p in cut], enc.counts(cut))
        for _ in range(4):
            a = rng.randint(0, len(text) + 2)
            text = tree.edit(text, a, a + rng.choice([0, 1, 20, 300]), "".join(rng.choice(signs) for _ in range(rng.choice([0, 2, 20]))), enc)
            cut = enc.cut(text)
            assert tree.total == sum(enc.counts(cut)) and tree.chars[1] == len(text)
            assert [x for s, _ in tree.leaves for x in s] == [len(p) for p in cut]


def test_token_counts_of_awkward_rows(spark, docs, none):
    enc = tokens.encoder(tokens.VOCABULARY)
    edits = spark.createDataFrame([(0, 2, 3, 9, "zz"), (0, 1, 0, 4, None), (11, 1, 100, 4000, "x y"), (99, 1, 0, 0, "q")], "doc_id long, seq int, start int, stop int, text string")
    got = tokens.apply_edits(tokens.plant(tokens.with_edits(docs, edits))).collect()
    assert len(got) == len(awkward())
    for r in got:
        assert r["edited_tokens"] == sum(enc.counts(enc.cut(r["edited"])))
    long = next(r for r in got if r["doc_id"] == 11)
    assert long["encoded"] < long["pieces"] / 10
    assert tokens.apply_edits(tokens.plant(tokens.with_edits(none, edits))).count() == 0


def test_kept_trees_take_a_second_batch(spark, docs):
    enc = tokens.encoder(tokens.VOCABULARY)
    schema = "doc_id long, seq int, start int, stop int, text string"
    one = spark.createDataFrame([(11, 1, 100, 4000, "x y"), (4, 1, 0, 9, "new"), (3, 1, None, None, "in front ")], schema)
    two = spark.createDataFrame([(11, 2, 50, 60, ""), (11, 1, 9000, 9001, "q"), (4, 1, 1, 2, " wz ")], schema)
    first = tokens.apply_edits(tokens.plant(tokens.with_edits(docs, one)))
    got = tokens.apply_edits(tokens.kept(first, two)).collect()
    texts = {r["doc_id"]: r["edited"] for r in first.collect()}
    for r in got:
        cut = enc.cut(r["edited"])
        assert r["edited_tokens"] == sum(r["counts"]) == sum(enc.counts(cut)) and r["sizes"] == [len(p) for p in cut]
        # Only what the second batch touched was encoded.
        assert r["encoded"] < 60 if r["doc_id"] in (4, 11) else r["encoded"] == 0
    by = {r["doc_id"]: r for r in got}
    assert by[4]["edited"] == "n wz w" and texts[3].startswith("in front ")
    t = texts[11]
    t = t[:9000] + "q" + t[9001:]
    assert by[11]["edited"] == t[:50] + t[60:]


# -- 6


def test_contained_items_against_sets(spark, docs, none):
    items = [(1, " ".join(prose(4000, 3).split()[1000:1030])), (2, prose(40, 99)), (3, "one two"), (4, None), (5, ""), (6, prose(70, 4)), (6, prose(70, 4)), (7, "a b c d e")]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((str(r["doc_id"]), r["item_id"], r["shared"]) for r in contamination.contained(docs, table).collect())
    expected = []
    for i, t, *_ in awkward():
        for k, item in items:
            n = min(5, len(words_of(item)))
            want = shingle_set(item, n) if n else set()
            w = words_of(t)
            have = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
            if want and len(want & have) >= 0.8 * len(want):
                expected.append((str(i), k, len(want & have)))
    assert got == sorted(expected)
    kept = contamination.clean(docs, table)
    assert kept.columns == docs.columns
    assert {str(r["doc_id"]) for r in kept.collect()} == {str(r[0]) for r in awkward()} - {x[0] for x in expected}
    assert contamination.contained(none, table).count() == 0
    assert contamination.contained(docs, table.limit(0)).count() == 0


# -- 7


def train_rows(n: int = 300):
    out, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = prose(20, 1000 + i) + (rng.choice([" grumpf", " gru mpf grumpfel", " grumpfig"]) if bad else "")
        out.append((i, text))
        labels.append((i, int(not bad), int(bad)))
    return out, labels


def test_toxicity_finds_disguised_words(spark, docs, none):
    rows, marks = train_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    lm = toxicity.language_model(toxicity.count_letters(table))
    lexicon = toxicity.learn(table, labels, "toxic", F.lit(True), lm)
    test = [(0, "sea wind grumpf stone"), (1, "sea gru.m.pf wind"), (2, "g r u m p f"), (3, "gruuumpf!"), (4, "sea of stone"), (5, None), (6, ""), (7, "wind 123 --- !!!")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(test, "doc_id long, text string"), lexicon, lm).collect()}
    assert all(got[i] >= 0.3 for i in (0, 1, 2, 3)) and all(got[i] < 0.3 for i in (4, 5, 6, 7))
    assert toxicity.score(docs, lexicon, lm).count() == len(awkward())
    empty = toxicity.learn(none, labels, "toxic", F.lit(True), lm)
    assert toxicity.score(docs, empty, lm).count() == len(awkward()) and toxicity.score(none, lexicon, lm).count() == 0


def plain_decode(token: str, lm) -> str:
    """The same lattice with whole texts carried along, for short tokens."""
    C = toxicity.COST
    states = {(0, 0, ""): (0.0, "")}
    for ch in token:
        options = [(c, C["swap"]) for c in toxicity.LOOKALIKES.get(ch, "")] + ([(ch, C["keep"])] if ch.isalpha() else [])
        ways = []
        for (a, b, last), (cost, text) in states.items():
            for c, extra in options:
                code = toxicity.letter_code(c)
                ways.append(((b, code, c), (cost + extra - float(lm[a, b, code]), text + c)))
            if last in [c for c, _ in options]:
                ways.append(((a, b, last), (cost + C["drop"], text)))
            if ch in toxicity.SEPARATORS or not options:
                ways.append(((a, b, last), (cost + C["separator"], text)))
        states = {state: min(w for s, w in ways if s == state) for state, _ in ways}
    return min((cost - float(lm[a, b, 0]), text) for (a, b, _), (cost, text) in states.items())[1]


def test_tokens_are_decoded_like_whole_texts():
    counts = np.random.default_rng(5).integers(0, 40, (toxicity.LETTERS,) * 3).astype(float)
    rng = random.Random(5)
    for lm in (toxicity.language_model(counts), np.full(counts.shape, -1.0, dtype=np.float32)):  # chance, and all ties
        for _ in range(150):
            token = "".join(rng.choice("aab11il.-#") for _ in range(rng.randint(1, 40)))
            assert toxicity.decode(token, lm) == plain_decode(token, lm)
        assert len(toxicity.decode("s3a-" * 50_000, lm)) > 100_000  # whole texts would copy 10 GB


def test_no_token_is_too_long_to_be_restored(spark):
    rows, marks = train_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    lm = toxicity.language_model(toxicity.count_letters(table))
    lexicon = toxicity.learn(table, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"), "toxic", F.lit(True), lm)
    tail = "-".join(["stone"] * 40)
    test = [(0, f"sea gru.m.pf-{tail}"), (1, f"sea {' '.join('grumpf' + 'stone' * 40)}"), (2, f"sea {tail}"), (3, f"sea {'.'.join(tail)}")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(test, "doc_id long, text string"), lexicon, lm).collect()}
    assert got[0] >= 0.3 and got[1] >= 0.3 and got[2] < 0.3 and got[3] < 0.3
    spaced = np.frombuffer(" ".join("sea" * 30).encode(), dtype=np.uint8)
    assert toxicity.suspects(spaced, np.array([0, len(spaced)])) == [(0, "sea" * 30)]
    signs = np.frombuffer(b"ab4" + b"$$++" * 100_000, dtype=np.uint8)
    assert toxicity.suspects(signs, np.array([0, len(signs)])) == [(0, "ab4")]


def test_letters_are_counted_like_one_at_a_time(spark):
    got = toxicity.count_letters(spark.createDataFrame([("Ab c",), (None,), ("",), ("b1é",)], "text string"))
    expected: dict = {}
    for t in ("ab c", "b1é"):
        a = b = 0
        for ch in [*t, " "]:
            c = toxicity.letter_code(ch) if ch.isalpha() else 0
            if b or c:
                key = (a if b else 0, b, c)
                expected[key] = expected.get(key, 0) + 1
            a, b = b, c
    assert {tuple(map(int, k)): int(got[tuple(k)]) for k in np.argwhere(got)} == expected


# -- 8


def test_quality_learns_and_handles_awkward_rows(spark, docs, none):
    from pyspark.sql import functions as F

    rows = [(i, prose(30, i) if i % 2 else prose(30, i).upper() + "!!!") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    model = quality.train(table, labels, "quality", F.lit(True))
    got = {r["doc_id"]: r["score"] for r in quality.score(table, model).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in got)
    assert quality.score(docs, model).count() == len(awkward()) and quality.score(none, model).count() == 0
    assert len(quality.train(none, labels, "quality", F.lit(True)).leaf) == 0


def test_trees_walk_like_one_row_at_a_time():
    x = np.random.default_rng(1).normal(size=(500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = quality.fit(x, y, trees=20, depth=3)
    for row, fast in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.base
        for stat, thr, leaf in zip(model.stat, model.threshold, model.leaf, strict=True):
            k = 0
            for _ in range(3):
                k = 2 * k + 1 + int(row[stat[k]] > thr[k])
            total += leaf[k - 7]
        assert abs(1 / (1 + np.exp(-total)) - fast) < 1e-9
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


# -- 9


def lines_brute(rows: list[tuple[int | None, str | None]]):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen: list = []
    out = {}
    for i, t in order:
        keep = []
        for line in (t or "").split("\n"):
            s = lines.normal(line)
            if s and any(s == x or (len(s) >= lines.NEAR and len(x) >= lines.NEAR and lines.within_one(s, x)) for x in seen):
                continue
            if s:
                seen.append(s)
            keep.append(line)
        out[i] = None if t is None else "\n".join(keep)
    return out


def test_line_dedup_against_all_pairs(spark, docs, none):
    rows = [(r[0], r[1]) for r in awkward()[:-3]]
    table = spark.createDataFrame(awkward()[:-3], SCHEMA)
    got = {r["doc_id"]: r for r in lines.dedup_lines(table).collect()}
    assert {i: r["text"] for i, r in got.items()} == lines_brute(rows)
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in got.values())
    assert lines.dedup_lines(docs).count() == len(awkward()) and lines.dedup_lines(none).count() == 0


def test_line_dedup_along_chains(spark):
    """A line that went covers none: of prefixes one letter apart every other one stays."""
    letters = "abcdefghijklmnopqrstuvwxyzäöüß0123456789"
    chain = [letters[:n] for n in range(36, 21, -1)]
    r = random.Random(4)
    rows = [(0, "\n".join(chain))]
    walk = list("the quick brown fox jumps over it")
    for i in range(1, 40):
        k = r.randrange(len(walk))
        walk[k : k + r.choice([0, 1])] = r.choice("xyz")
        rows.append((i, "".join(walk) + "\n" + "".join(r.choice("ab") for _ in range(21))))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(table).collect()}
    assert got == lines_brute(rows)
    assert got[0] == "\n".join(chain[::2])


def test_line_dedup_names_its_columns(spark):
    rows = [(1, "a line of text that is long", 7, "k"), (2, "a line of text that is long", 8, "k")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lines_kept int, _first string")
    with pytest.raises(ValueError):
        lines.dedup_lines(table)
    got = lines.dedup_lines(table, ("gone", "left"))
    assert got.columns == ["doc_id", "text", "lines_kept", "_first", "gone", "left"]
    assert sorted(map(tuple, got.collect())) == [(1, rows[0][1], 7, "k", 0, 1), (2, "", 8, "k", 1, 0)]


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", min_size=0, max_size=8), st.text("ab ", min_size=0, max_size=8))
def test_edit_distance_of_one(a, b):
    def distance(x: str, y: str) -> int:
        if not x or not y:
            return len(x) + len(y)
        return min(distance(x[1:], y) + 1, distance(x, y[1:]) + 1, distance(x[1:], y[1:]) + (x[0] != y[0]))

    assert lines.within_one(a, b) == (distance(a, b) <= 1)


@settings(max_examples=200, deadline=None)
@given(st.text("abcde ", min_size=20, max_size=60), st.integers(0, 60), st.sampled_from("xyz"), st.sampled_from("sid"))
def test_lines_within_one_edit_share_keys(a, at, ch, kind):
    at = min(at, len(a) - 1)
    b = a[:at] + (ch + a[at + 1 :] if kind == "s" else ch + a[at:] if kind == "i" else a[at + 1 :])
    if a == b:
        return
    assert set(lines.block_keys(a, 2)) & set(lines.block_keys(b, 2))
    ka, kb = lines.block_keys(a, lines.BLOCKS), lines.block_keys(b, lines.BLOCKS)
    va = lines.variant_keys(a, [q for q, k in enumerate(ka) if k in kb])
    vb = lines.variant_keys(b, [q for q, k in enumerate(kb) if k in ka])
    kinds = [{(k, min(r, 1)) for k, r in zip(*v, strict=True)} for v in (va, vb)]
    assert kinds[0] & kinds[1]


# -- 10


def test_language_of_awkward_rows(spark, docs, none):
    from pyspark.sql import functions as F

    rows = [(i, prose(30, i), "x") for i in range(50)] + [(100 + i, "zuber schaft ung keit " * 9, "y") for i in range(50)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(table, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(table, model).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows) and all(0 <= s <= 1 for _, s in got.values())
    odd = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model).where("doc_id is not null").collect()}
    assert odd[4] == odd[5] == odd[6] == odd[9] == "und" and odd[7] in ("x", "y")
    assert language.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in language.identify(docs, language.train(none, F.lit(True))).collect()} == {"und"}


def test_bundle_is_the_sum_of_bound_letters():
    text = "Ab, cé"
    vec, _ = language.bundle([text], 64)
    a, b, c = language._vectors(64)
    code = language._letters()
    letters = [0, *(int(code[ord(x)]) for x in "ab"), 0, *(int(code[ord(x)]) for x in "cé"), 0]
    expected = np.zeros(64)
    for k in range(len(letters) - 2):
        x, y, z = letters[k : k + 3]
        expected += a[x].astype(int) * b[y] * c[z]
    assert (vec[0] == expected).all()


# -- all


def test_shingles_against_sets():
    texts = [r[1] or "" for r in awkward()]
    for _, _, data, offs in K.runs(K.lower_text(pa.array(texts)), 4000):
        assert len(offs) >= 2
    found = [len(np.unique(h[a:b])) for _, _, d, o in K.runs(K.lower_text(pa.array(texts)), 4000) for h, p in [K.shingles(d, o, 5)] for a, b in zip(p[:-1], p[1:], strict=True)]
    assert found == [len(shingle_set(t)) for t in texts]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, sf_dir, name):
    assert compare.difference(spark, sf_dir, queries.QUERIES[name], queries.SQL[name]) is None


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    columns = docs.columns
    for name, stage in P.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = P.stored(stage(spark, docs, sf_dir), "stage")
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if stage is P.drop_toxic:
            gone = set(before) - set(after)
            assert all(labels.get(i, 1) for i in gone)
        elif stage is P.drop_repeated_lines:
            expected = lines_brute([(i, r["text"]) for i, r in before.items()])
            assert {i: t for i, t in expected.items() if t.strip()} == {i: r["text"] for i, r in after.items() if r["text"].strip()}
        elif stage is P.keep_one_of_near_copies:
            _, group = near_brute([(i, r["text"]) for i, r in before.items()])
            first: dict = {}
            for i in sorted(before):
                first.setdefault(group[before[i]["text"] or ""], i)
            assert set(after) == set(first.values())
        elif stage is P.drop_benchmark_items:
            items = [shingle_set(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            held = {i for i, r in before.items() if any(len(s & shingle_set(r["text"])) >= 0.8 * len(s) for s in items)}
            assert set(after) == set(before) - held
        if stage is not P.encode_pieces:
            assert out.columns == columns
        docs = out
    m = pieces.model(pieces.MODEL)
    for i, r in after.items():
        assert m.decode(np.array(r["pieces"], dtype=np.int32), np.array([0, len(r["pieces"])]))[0].decode() == before[i]["text"]
