"""The registered queries of this subpackage, one per operator, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunking, contamination, fertility, language, lines, near, periodic, pieces, quality, ring, spelling, tokens, toxicity
from .common import held_out, table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined fingerprints of every text, its edited text and the next one."""
    return chunking.compare_with_next(table(spark, sf_dir, "documents"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every document, and the hash of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pieces.decode(pieces.encode(docs).drop("text"))
    return rows.select(
        "doc_id", F.size("pieces").alias("n_pieces"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "pieces"
    )


def op3_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy class and links of every document: five words, similarity 0.8."""
    return near.near_classes(table(spark, sf_dir, "documents"))


NEAR_SQL = r"""
with recursive t as (
  select coalesce(text, '') as text, min(doc_id) as first, count(*) as copies from documents group by 1),
w as (
  select first, list_filter(string_split_regex(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '') as w from t),
s as (
  select distinct first, array_to_string(w[i:i + 4], ' ') as sh
  from (select first, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from w where len(w) > 0)),
n as (select first, count(*) as n from s group by first),
l as (
  select a.first as a, b.first as b
  from s a join s b on a.sh = b.sh and a.first <> b.first
  join n x on x.first = a.first join n y on y.first = b.first
  group by a.first, b.first having count(*) >= 0.8 * (any_value(x.n) + any_value(y.n) - count(*))),
r as (select first as a, first as b from t union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as class_id from r group by a),
k as (select a, count(*) as links from l group by a)
select d.doc_id, c.class_id, coalesce(k.links, 0) as links, t.copies
from documents d join t on t.text = coalesce(d.text, '') join c on c.a = t.first left join k on k.a = t.first"""


def op4_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of a ring with bounded loads; law ``rows``."""
    docs = table(spark, sf_dir, "documents")
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return ring.shard(rows, "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after two edits of its text: near
    a third of it a stretch is replaced by the text's start, in the middle one goes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    third, half = F.floor(n / 3), F.floor(n / 2)
    edits = F.array(
        F.struct(
            third.cast("int").alias("start"), (third + F.floor(n / 16)).cast("int").alias("stop"),
            F.substring("text", F.lit(1), F.floor(n / 32).cast("int")).alias("text"),
        ),
        F.struct(half.cast("int").alias("start"), (half + F.floor(n / 64)).cast("int").alias("stop"), F.lit("").alias("text")),
    )
    rows = tokens.apply_edits(tokens.plant(docs.withColumn("edits", edits)), leaves=False)
    return rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).drop("edited")


def op6_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain, by five-word shingles at 0.8."""
    return contamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


CONTAMINATION_SQL = r"""
with w as (
  select 'd' as side, doc_id as id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f\v]+'), lambda x: x <> '') as w
  from documents
  union all
  select 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f\v]+'), lambda x: x <> '')
  from benchmark),
s as (
  select distinct side, id, i as pos, array_to_string(w[i:i + 4], ' ') as sh
  from (select side, id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from w where len(w) > 0)),
u as (select distinct side, id, sh from s),
n as (select id, count(*) as shingles from u where side = 'i' group by id)
select d.id as doc_id, i.id as item_id, count(*) as shared, any_value(n.shingles) as shingles,
  count(*) / any_value(n.shingles)::double as containment
from u d join u i on d.sh = i.sh and d.side = 'd' and i.side = 'i' join n on n.id = i.id
group by d.id, i.id having count(*) >= 0.8 * any_value(n.shingles)"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document after deobfuscation."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lm = toxicity.language_model(toxicity.count_letters(docs))
    lexicon = toxicity.learn(docs, labels, "toxic", ~held_out(4, 2), lm)
    scored = toxicity.score(docs.select("doc_id", "text"), lexicon, lm)
    return scored.select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by boosted trees over its statistics."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, "quality", ~held_out(5, 0))
    return quality.score(docs, model).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with only the earliest of equal and nearly equal lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "lines_kept", "lines_dropped", "text")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by hyperdimensional profiles."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, ~held_out(5, 0))
    return language.identify(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")


# The CRC-32 of the UTF-8 of a text, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(generate_series(1, octet_length(encode({0}))),
      lambda k: ('0x' || substr(hex(encode({0})), 2 * k - 1, 2))::bigint)),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))))"""


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, one in ten with a repeated tail."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = periodic.find_runs(periodic.with_repeated_tails(docs)).withColumn("best", periodic.longest_run(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(listed, lambda line: F.concat(line, F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


RUNS_SQL = rf"""
with t as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    {CRC_SQL.format("cast(doc_id as varchar)")} as h from documents),
a as (select *, len(w) as n, h // 10 as g, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from t),
p as (select *, 1 + (n - a) // (3 + g % 8) as p from a),
e as (
  select doc_id, n, case when a is null then w
    else list_concat(w[:a], flatten(list_transform(generate_series(0, (n - a) // p), lambda k: w[a + 1:a + p])))[:n] end as w
  from p),
x as (select doc_id, n, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from e),
m as (
  select a.doc_id, a.i, b.i - a.i as q from x a join x b on a.doc_id = b.doc_id and a.word = b.word and b.i > a.i
  where 4 * (b.i - a.i) <= a.n),
s as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as part from m),
r as (
  select doc_id, q, min(i) as start, count(*) + q as length from s
  group by doc_id, q, part having count(*) + q >= greatest(6, 4 * q)),
u as (select doc_id, start, length, min(q) as q from r group by all),
k as (
  select x.doc_id, string_agg(word, ' ' order by i) as kept from x
  where not exists (select 1 from u where u.doc_id = x.doc_id and x.i >= u.start + u.q and x.i < u.start + u.length)
  group by x.doc_id),
g as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as listed,
    arg_max(u, row(length, -start, -q)) as best from u group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, best.start as start, best.length as length, best.q as period,
  1000 * best.length // best.q as exponent_milli,
  sha256(coalesce(listed, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
from documents d left join g on g.doc_id = d.doc_id left join k on k.doc_id = d.doc_id"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and roots of all words of seven letters or more, some with a letter lost."""
    return spelling.group_variants(table(spark, sf_dir, "documents"), slip=31)


SPELLING_SQL = rf"""
with recursive t as (
  select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as raw from documents where text is not null),
l as (
  select doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as raw, count(*) as n
  from t where length(raw) >= 7 group by all),
h as (select *, doc_id || ':' || raw as named from l),
c as (select raw, n, {CRC_SQL.format("named")} as h from h),
w as (
  select case when h % 31 = 0 then substr(raw, 1, h % length(raw)) || substr(raw, h % length(raw) + 2) else raw end as word,
    sum(n)::bigint as n
  from c group by all),
v as (select word, n from w where length(word) >= 7 and n >= 2),
d as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as key
  from (select word, n, unnest(generate_series(1, length(word))) as i from v)),
p as (
  select a.word as a, b.word as b, b.n from d a join d b on a.key = b.key and a.i = b.i and a.word <> b.word
  union
  select a.word, b.word, b.n from d a join v b on a.key = b.word
  union
  select b.word, a.word, a.n from d a join v b on a.key = b.word),
k as (select a, count(*) as n_near, max(n) as top from p group by a),
m as (select k.a, n_near, top, min(p.b) as best from k join p on p.a = k.a and p.n = k.top group by all),
f as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when top >= 10 * v.n then best end as form,
    case when top >= 10 * v.n then top end as form_n
  from v left join m on m.a = v.word),
r as (
  select word, word as root, form as onward from f
  union all
  select r.word, r.onward, f.form from r join f on f.word = r.onward)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from f join r on r.word = f.word and r.onward is null"""


def op13_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain counts of every document, and whether rules and fertility bands keep it."""
    return fertility.rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "outside"
    )


QUERIES = {q.__name__: q for q in (op1_fingerprints, op2_pieces, op3_near, op4_ring, op5_tokens, op6_contamination, op7_toxicity, op8_quality, op9_lines, op10_language, op11_runs, op12_spelling, op13_fertility)}
SQL: dict[str, str] = {"op3_near": NEAR_SQL, "op6_contamination": CONTAMINATION_SQL, "op11_runs": RUNS_SQL, "op12_spelling": SPELLING_SQL}
