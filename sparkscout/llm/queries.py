"""Registered queries of the training-data operators: each applies one
operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (alignment, bpe, html_blocks, ibltprint, langid, nndescent, packing, passages, quality, simhash, tokenstore,
               toxicity, variants)
from .base import crc_mod, scratch_path, table
from .tokenizing import public_path

#: the id appended to every document by the token store and packing queries
END_ID = 2


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash.simhash_groups(docs, shingle=4, radius=4, seed=42).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    model = toxicity.learn(docs, labels.filter(~held_out))
    return toxicity.score(docs, model, threshold=0.7).select("doc_id", held_out.alias("held_out"), "score",
                                                             "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = langid.learn(docs.filter(~held_out), public_path("piece_bpe_32k.model"))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nndescent.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)
    return found.select("query_id", "rank", "vec_id", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup_passages(table(spark, sf_dir, "documents"), min_words=50).select(
        "doc_id", "text", "n_deleted_lines", "n_deleted_words")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "tokenstore")
    tokenstore.write_store(docs, path, public_path("word_bpe_49k.json"), END_ID, spaces_matter=False)
    return tokenstore.lookup(docs, path)


def op8_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdict(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "char_distance", "word_distance")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"),
                                  END_ID, capacity=1024).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"),
                              public_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ibltprint.fingerprints(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_groups(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.cross_alignment(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"),
                                     public_path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_html_text, op2_simhash, op3_toxicity, op4_language_id, op5_nn_descent, op6_line_dedup,
           op7_token_store, op8_quality_divergence, op9_best_fit_packing, op10_byte_bpe, op11_document_fingerprints,
           op12_spelling_variants, op13_token_alignment)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {}
