"""Fixtures of the tests in this folder."""

import random

import pytest
from pyspark.sql import types as T

from sparkscout.llm.tokenizing import public_path

SF_SMALL, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

EXTRA = ["_id", "_text", "_lang_pred", "_toxicity", "_deleted", "_changed", "_keep", "_place", "fp", "component",
         "score", "position", "start", "length", "n", "id"]


@pytest.fixture(scope="session")
def paths():
    return {k: public_path(v) for k, v in {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json",
                                           "multi": "byte_bpe_multi_50k.tiktoken",
                                           "piece": "piece_bpe_32k.model"}.items()}


def odd_texts() -> list[str | None]:
    rng = random.Random(5)
    passage = "\n".join(" ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randint(0, 9))
                                 for _ in range(12)) for _ in range(7))
    return [None, "", " ", "\n\n", "a", "The cat sat on the mat.", "The cat sat on the mat.", "x" * 30_000,
            "word " * 20_000, passage, "before\n" + passage, passage + "\nafter", "\ttab and  two\r\nspaces ",
            "İstanbul ΣΑΣ é 日本語 🙂", "123 456 !!!", "&amp; <b>", "<|endoftext|> 's 're", passage]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, repeated rows and ids, very long texts, and
    extra columns with the names that operators use inside."""
    rows = [(k, t, "en" if k % 3 else "fr", "s", len(t or "")) for k, t in enumerate(odd_texts())]
    rows += [rows[5], rows[5], (5, "another text under the same id", None, None, None),
             (None, "a row without id", "en", None, None), (None, None, None, None, None)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType())])
    df = spark.createDataFrame(rows, schema)
    for c in EXTRA:
        df = df.selectExpr("*", f"'extra' as `{c}`")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(18)] + [(3, 1, None), (None, 1, 1), (4, 0, 0)],
                                 "doc_id long, quality int, toxic int")
