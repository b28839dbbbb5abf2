"""Nulls, empty and very long texts, repeated rows, empty tables and clashing
extra columns, for every operator and pipeline stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_data import labels, no_docs, odd_docs, paths  # noqa: F401
from sparkscout.llm import (bpe, html_blocks, langid, nndescent, packing, passages, quality, simhash,
                            tokenstore, toxicity)
from sparkscout.llm.base import scratch_path

N = 23          # rows of odd_docs


def _store(docs, paths):
    path = scratch_path(docs.sparkSession, "store")
    tokenstore.write_store(docs, path, paths["word"], 2, False)
    return tokenstore.lookup(docs, path)


OPERATORS = {
    "simhash": lambda d, p, lab: simhash.simhash_groups(d),
    "toxicity": lambda d, p, lab: toxicity.score(d, toxicity.learn(d, lab)),
    "langid": lambda d, p, lab: langid.predict(d, langid.learn(d, p["piece"], rounds=1)),
    "passages": lambda d, p, lab: passages.dedup_passages(d, 50),
    "tokenstore": lambda d, p, lab: _store(d, p),
    "quality": lambda d, p, lab: quality.quality_verdict(d),
    "bpe": lambda d, p, lab: bpe.bpe_round_trip(d, p["multi"], public_tokenizers.PATTERN),
    "bpe_ids": lambda d, p, lab: bpe.bpe_decode(bpe.bpe_encode(d, p["multi"], public_tokenizers.PATTERN),
                                                p["multi"], public_tokenizers.PATTERN),
    "html": lambda d, p, lab: html_blocks.extract(d.withColumnRenamed("text", "html"), "doc_id", "source", "html"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row(odd_docs, labels, paths, name):
    rows = OPERATORS[name](odd_docs, paths, labels).collect()
    assert len(rows) == N
    assert sorted(r["doc_id"] is None for r in rows) == [False] * (N - 2) + [True] * 2


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(no_docs, labels, paths, name):
    assert OPERATORS[name](no_docs, paths, labels).collect() == []


def test_packing_covers_every_row(odd_docs, no_docs, paths):
    got = packing.pack_documents(odd_docs, paths["byte"], 2, 64).toPandas()
    assert (got.piece == 0).sum() == N
    assert packing.pack_documents(no_docs, paths["byte"], 2, 64).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages(spark, odd_docs, no_docs, labels, k, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd_docs, str(tmp_path))
    rows = out.count()
    if k < 4:
        assert out.columns == odd_docs.columns
        assert 0 < rows <= N
        assert out.filter("score <> 'extra' or _keep <> 'extra'").count() == 0
    empty = stage(spark, no_docs, str(tmp_path))
    assert empty.count() == 0 and empty.columns == out.columns


def test_vectors_that_take_no_part(spark):
    rows = [(k, [float(k), 1.0], k) for k in range(1, 30)]
    rows += [(100, [5.0, 1.0], 0), (101, [5.0, 1.0], 0), (101, [5.0, 1.0], 0), (40, None, 0), (41, [], 0),
             (42, [0.0, 0.0], 0), (43, [None, 1.0], 0), (44, [float("nan"), 1.0], 0), (45, [float("inf"), 1.0], 0),
             (46, [1.0], 0), (None, [1.0, 1.0], 0), (200, [0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long")
    got = nndescent.nearest(df, F.col("id") % 100 == 0).orderBy("rank").collect()
    assert {r["query_id"] for r in got} == {100}
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got][:4] == [(1, 5, 0.0), (2, 101, 0.0), (3, 4, 1.0),
                                                                      (4, 6, 1.0)]
    assert len(got) == 10
    few = nndescent.nearest(df.filter("vec_id in (100, 5, 6)"), F.col("id") % 100 == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in few] == [5, 6]
    assert nndescent.nearest(df.filter("false"), F.col("id") % 100 == 0).collect() == []
