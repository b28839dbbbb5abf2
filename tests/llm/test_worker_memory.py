"""Python workers are reused by the stages of a pipeline: what one leaves
behind must not count against the next."""

import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from conftest import ROOT
from sparkscout.llm import base, langid, packing, tokenizing, toxicity
from sparkscout.llm.tokenizing import public_path

_GIVES_BACK = """
import re, sys
sys.path.insert(0, sys.argv[1])
from sparkscout.llm import base
def mb():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
cache = [bytes(600) for _ in range(200_000)]
last = [bytes(600) for _ in range(10)]
base.take_over("one", cache.clear)
full = mb()
base.take_over("two", lambda: None)
assert not cache
assert full - mb() > 80, (full, mb())
"""


def test_dropped_caches_go_back_to_the_system():
    subprocess.run([sys.executable, "-c", _GIVES_BACK, ROOT], check=True, timeout=120)


class _Task(Exception):
    pass


def _caught(monkeypatch, module, start):
    """The task that an operator hands to Spark."""
    def catch(df, fn, schema):
        raise _Task(fn)
    monkeypatch.setattr(module, "arrow_map", catch)
    with pytest.raises(_Task) as e:
        start()
    return e.value.args[0]


def test_learning_tasks_drop_other_caches(spark, monkeypatch):
    path = public_path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(1, "a b", 1)], "_id long, _text string, _y int")
    monkeypatch.setattr(toxicity, "materialise", lambda df, name: rows)
    monkeypatch.setattr(toxicity, "training_rows", lambda *a: rows)
    monkeypatch.setattr(toxicity, "find_features", lambda *a: ["a"])
    tasks = [_caught(monkeypatch, langid, lambda: langid._expected_counts(rows, path, {}, np.ones((1, 1)))),
             _caught(monkeypatch, toxicity, lambda: toxicity.learn(rows, rows))]
    for task in tasks:
        dropped = []
        base.take_over("tokenizing", lambda: dropped.append(True))
        list(task(iter([])))
        assert dropped


def test_tasks_read_large_batches_in_slices(spark, monkeypatch):
    """Not every text of an Arrow batch is a Python object at the same time."""
    texts = ["idiot x " * 100, None, "", "a nice day " * 200, "c" * 5000, "d"] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = public_path("piece_bpe_32k.model")
    size = len(langid.vocabulary(path)) + 1
    model = langid.Model(path, ["en", "fr"], np.full((size, 2), 1 / size))
    for module, start in (
            (langid, lambda: langid.mark_rows(docs, model, "text", "lang_pred", "score")),
            (toxicity, lambda: toxicity.mark_rows(docs, toxicity.fallback_model(), "text", "score")),
            (packing, lambda: packing.pieces(docs, public_path("byte_bpe_50k.json"), 2, 1024))):
        task = _caught(monkeypatch, module, start)
        whole = pa.Table.from_batches(list(task(iter([batch]))))
        monkeypatch.setattr(base, "SLICE_BYTES", 4000)
        parts = list(task(iter([batch, batch.slice(0, 0)])))
        monkeypatch.undo()
        assert len(parts) > 20 and pa.Table.from_batches(parts).drop_columns(
            ["score"] if module is langid else []).equals(whole.drop_columns(["score"] if module is langid else []))


def test_words_go_to_the_library_in_parts(monkeypatch):
    """Its results take far more memory than the ids that are kept."""
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmn" for c in "opqrst"]
    text = " ".join(words)
    enc = tokenizing.ChunkEncoder(public_path("byte_bpe_50k.json"), True)
    calls, real = [], enc._word_ids
    monkeypatch.setattr(tokenizing, "CALL_WORDS", 50)
    monkeypatch.setattr(enc, "_word_ids", lambda tok, part: calls.append(len(part)) or real(tok, part))
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.tok.encode(text, add_special_tokens=False).ids
    assert max(calls) <= 50 and sum(calls) >= len(words) - 1


def test_batches_of_texts_are_bounded(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    def largest():
        return max(r["n"] for r in base.arrow_map(spark.range(0, 9000, 1, 1), sizes, "n long").collect())

    try:
        spark.conf.set(setting, "10000")
        assert largest() <= base.BATCH_ROWS
        spark.conf.set(setting, "100")
        assert largest() == 100
    finally:
        spark.conf.set(setting, before)


def test_tasks_give_free_memory_back_at_their_end(monkeypatch):
    given = []
    monkeypatch.setattr(base, "_give_back", lambda: given.append(True))
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None])], ["text"])
    assert sum(b.num_rows for b in base.slices(iter([batch, batch]), 0)) == 4
    assert given == [True]
