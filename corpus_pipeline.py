"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, folder of tables), works on all that the one
before kept, and its result is written as Parquet and read again. All but the
last return the columns of ``documents``; the last returns each row's piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexisim.llm import mixing, ngram_jaccard, quality_classifier, quality_rules, sentencepiece
from lexisim.llm.common import materialise, release


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good.

    Null and empty texts are scored as any other; equal texts share their verdict, so repeated rows stay or go
    together; without labels every score is 0.5 and all stay; an empty table gives an empty one.
    """
    return quality_classifier.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep.

    Null and empty texts have too few words and go; rows that repeat id and text stay or go together; without
    trusted documents the base rules alone decide; an empty table gives an empty one.
    """
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles with a similarity of 0.8 or more link.

    The smallest ``doc_id`` stays (null last), then the smallest set name and row hash; rows without words are in no
    group and stay; an empty table gives an empty one.
    """
    return ngram_jaccard.keep_one(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Rows without words are taken 0 times; a null source is one of its own; rows that repeat id, source and size share
    what the mix takes of them; an empty table gives an empty one.
    """
    return mixing.apply(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and lossless of each document of the mix.

    Repeated rows get equal ids; null texts would have null ids; an empty table gives an empty one.
    """
    return sentencepiece.encode(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("ngram_jaccard_join", remove_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Models, draws and a seeded tree walk have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus made from ``documents`` in the folder ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
