"""The near-dedup stage keeps one row of each group, whatever the ids."""

import random

from sparkscout.llm import simhash


def test_one_survivor_per_group(spark):
    rng = random.Random(9)

    def prose():
        return " ".join(f"w{rng.randrange(10**9)}" for _ in range(60))
    a, b, c, d, e, f = (prose() for _ in range(6))
    rows = [(None, a), (None, b), (None, a), (None, c), (3, c), (7, d), (7, e), (7, d), (5, f), (6, f), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_first(df).collect()]
    want = [(None, a), (None, b), (3, c), (7, d), (7, e), (5, f), (None, None)]
    assert len(got) == len(want) and set(got) == set(want)


def test_other_operators_caches_are_dropped(spark, monkeypatch):
    """Workers are reused: what earlier stages cached goes when these tasks start."""
    from sparkscout.llm import base, passages
    docs = spark.createDataFrame([(1, 2, "a b")], "id long, text_hash long, text string")
    for module, start in ((simhash, lambda: simhash.fingerprints(docs, id_col="id")),
                          (passages, lambda: passages.stretch_table(docs, 50))):
        tasks, dropped = [], []
        monkeypatch.setattr(module, "arrow_map", lambda df, fn, schema: tasks.append(fn) or df)
        start()
        base.take_over("langid", lambda: dropped.append(True))
        assert not list(tasks[0](iter([]))) and dropped
