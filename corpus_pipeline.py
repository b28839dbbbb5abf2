"""Corpus pipeline: language ID, toxicity, line dedup, SimHash near-dedup and
best-fit packing, one after another over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns they were given.

Defined cases: a table without rows passes through every stage; rows that
repeat a document id, or have none, are judged one by one, also by the
near-dedup stage, which keeps one row of each group; columns besides those of ``documents`` are kept as
they are by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkscout.llm import langid, packing, passages, simhash, toxicity
from sparkscout.llm.base import crc_mod, scratch_path, table
from sparkscout.llm.tokenizing import public_path
from sparkscout.session import remove, scope

#: a document goes if no language is at least this likely
LEAST_LANGUAGE_SCORE = 0.5
TOXIC_FROM = 0.7
#: words of a passage that may not stand in the corpus twice
PASSAGE_WORDS = 50
CAPACITY, END_ID = 1024, 2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; ``und`` and undecided ones go.
    Learns from this stage's own labelled rows outside the held-out fold."""
    model = langid.learn(docs.filter(crc_mod("doc_id", 5) != 0), public_path("piece_bpe_32k.model"))
    return langid.filter_rows(docs, model, LEAST_LANGUAGE_SCORE)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold stay."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    return toxicity.filter_rows(docs, model, TOXIC_FROM)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages of words are deleted from the texts, wherever
    in a line they stand; no row goes."""
    return passages.rewrite(docs, PASSAGE_WORDS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_first(docs, shingle=4, radius=4)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their places in sequences."""
    return packing.pack_documents(docs, public_path("byte_bpe_50k.json"), END_ID, CAPACITY)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: not expressible in SQL: learned models, whole-text tokenizers
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared
    folder and read again.  A stage's intermediate tables, and the documents
    that it was given, are deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
