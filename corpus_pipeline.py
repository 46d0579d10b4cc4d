"""A training-data pipeline over ``documents``: toxic documents go, repeated lines
go, one document of each group of near copies stays, documents with benchmark
items go, and what is left is written as sampled pieces.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept.  All but the last give back the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetboard.llm import contamination, lines, near, pieces, toxicity
from fleetboard.llm.common import free, held_out, stored, table

REJECT = 0.3  # toxicity score from which a document goes


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under ``REJECT``; NULL and empty texts stay."""
    lm = toxicity.language_model(toxicity.count_letters(docs))
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out(4, 2), lm)
    name = free(docs, "score")
    return toxicity.score(docs, lexicon, lm, name).where(F.col(name) < REJECT).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; a document of which
    nothing but blank lines is left goes, one that was so before stays."""
    dropped, left = free(docs, "lines_dropped"), free(docs, "lines_kept")
    found = lines.dedup_lines(docs, (dropped, left))
    return found.where((F.col(left) > 0) | (F.col(dropped) == 0)).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of equal or near texts."""
    return near.keep_one(docs).select(*docs.columns)


def drop_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces): every text as sampled pieces, which decode to it."""
    return pieces.encode(docs.select("doc_id", "text")).select(
        "doc_id", F.when(F.col("pieces").isNull(), 0).otherwise(F.size("pieces")).alias("n_pieces"), "pieces"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_items),
    ("sentencepiece encoding", encode_pieces),
]

# A classifier, a sampler and a language model are not SQL; the tests hold the
# stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
