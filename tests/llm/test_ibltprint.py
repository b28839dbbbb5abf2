"""Document fingerprints against a brute-force comparison of paragraph lists."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_data import SF_SMALL, labels, no_docs, odd_docs, paths  # noqa: F401
from sparkscout.llm import ibltprint
from sparkscout.llm.queries import op11_document_fingerprints


def brute_likeness(a: str, b: str) -> float:
    x, y = Counter(ibltprint.paragraphs(a)), Counter(ibltprint.paragraphs(b))
    total = x.total() + y.total()
    return 1.0 if total == 0 else 1.0 - ((x - y).total() + (y - x).total()) / total


def brute(rows):
    """Expected (doc_id, n_chars, sha, near_edited, near_next) of rows in order."""
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), brute_likeness(t, edited), brute_likeness(t, after)))
    return out


def result(df):
    return [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in df.collect()]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want])


def test_query_against_brute_force(spark):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()),
                  reverse=True)
    same(result(op11_document_fingerprints(spark, SF_SMALL)), brute(rows))


@pytest.mark.parametrize("partitions", [1, 7])
def test_neighbours_across_partitions(spark, partitions):
    rows = [(k, "\n".join(f"line {(k * j) % 17} of some text." for j in range(k % 40))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    same(result(ibltprint.fingerprints(df)), brute(rows[::-1]))


def test_odd_rows(odd_docs, no_docs):
    got = ibltprint.fingerprints(odd_docs).collect()
    assert len(got) == odd_docs.count()
    prints = {}
    for r in odd_docs.groupBy("doc_id", F.coalesce("text", F.lit("")).alias("t")).count().collect():
        prints[r["doc_id"]] = prints.get(r["doc_id"], 0) + r["count"]
    assert Counter(r["doc_id"] for r in got) == prints
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert ibltprint.fingerprints(no_docs).collect() == []
    one = ibltprint.fingerprints(odd_docs.filter("doc_id = 9")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_equal_texts_have_equal_fingerprints(spark):
    df = spark.createDataFrame([(k, "One. Two. Three." if k % 2 else "Four.\nFive") for k in range(60)], "doc_id long, text string")
    got = ibltprint.fingerprints(df).collect()
    assert len({(r["doc_id"] % 2, r["fingerprint"]) for r in got}) == 2


def test_a_third_of_the_rows_share_an_id(spark):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k % 50}. and more {k}.") for k in range(900)]
    got = ibltprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows)


def test_peeling_recovers_the_differing_digests():
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 5, 40, 900, 20_000)]
    common = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    texts = [np.concatenate([common, x]) for x in lists]
    offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    left, right = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(6)))
    pair, key, sign = ibltprint.differences(offsets, np.concatenate(texts), left, right)
    for p, (a, b) in enumerate(zip(left, right)):
        mine = pair == p
        assert set(key[mine & (sign == 1)]) == set(lists[a]) - set(lists[b])
        assert set(key[mine & (sign == -1)]) == set(lists[b]) - set(lists[a])


def test_a_text_of_many_megabytes(spark):
    text = " ".join(f"word{k % 9973}" + ("." if k % 11 == 0 else "") for k in range(3_000_000))
    got = ibltprint.fingerprints(spark.createDataFrame([(1, text), (2, text[:-3] + "xyz")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_chars"] for r in got} == {1: len(text), 2: len(text)}
    assert all(0.999 < r["near_next"] < 1 and r["near_edited"] > 0.49 for r in got)
