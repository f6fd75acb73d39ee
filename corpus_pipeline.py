"""The corpus pipeline: documents in, packed sequences out.

Each stage works on all that its predecessor kept; every stage but the last returns the columns of
documents. What a stage rejects is gone from the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cindertally.llm import line_dedup, ngram_join, packing, quality_gam, quality_rules
from cindertally.llm.queries import tokenizer, trusted
from cindertally.session import stored, table


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores 0.7 or more."""
    return quality_gam.accepted(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep."""
    return quality_rules.accepted(docs, trusted(spark, sf_dir))


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeats of runs of lines."""
    return line_dedup.without_repeats(docs)


def by_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=1, window=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", by_classifier),
    ("quality_rules", by_rules),
    ("line_dedup", by_lines),
    ("ngram_jaccard_join", by_near_copies),
    ("packing", packed),
]

#: No SQL: the stages tokenize, learn and hash outside of what SQL can express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
