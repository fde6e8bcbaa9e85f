"""Corpus pipeline: quality classifier, rules, near-dedup, mixing, encoding.

Each stage takes the documents its predecessor kept, in full, and all but the last give rows
with the columns of ``documents``. The driver of the pipeline writes each result as Parquet and
reads it back for the next stage; ``run`` does so too, in the folder all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clonoframe.llm import (
    mixing,
    near_dedup,
    quality_gam,
    quality_rules,
    unigram_tokens,
)
from clonoframe.llm.queries import labels_to_learn
from clonoframe.llm.shared import staged, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents scored as good; the classifier learns from this stage's documents."""
    model = quality_gam.train(docs, labels_to_learn(spark, sf_dir))
    return quality_gam.accepted(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents the default rule policy passes."""
    return quality_rules.filtered(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return near_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources near their target weights."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text: doc_id, source, lang, n_pieces, ids."""
    return unigram_tokens.encoded(docs, unigram_tokens.vocabulary(spark)).selectExpr(
        "doc_id", "source", "lang", "cast(size(ids) as long) as n_pieces", "ids"
    )


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("near-dedup", dedup),
    ("mixing", mix),
    ("piece encoding", encode),
]
#: Boosted tables and MinHash candidates have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
