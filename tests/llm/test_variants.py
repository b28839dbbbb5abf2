"""Spelling variants against a brute-force comparison of all words."""

import random
import re
import zlib
from collections import Counter, defaultdict

from llm_data import SF_MID, SF_SMALL, labels, no_docs, odd_docs, paths  # noqa: F401
from sparkscout.llm import variants
from sparkscout.llm.queries import op12_spelling_variants


def brute_counts(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(counts):
    """Near words by wildcards: equal with the same place left out or open."""
    cells = defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            cells["r", k, w[:k] + "\0" + w[k + 1:]].add(w)
            cells["d", w[:k] + w[k + 1:]].add(w)
    near = {w: set() for w in counts}
    for key, ws in cells.items():
        if key[0] == "r":
            for a in ws:
                near[a] |= ws - {a}
        elif key[1] in counts:
            near[key[1]] |= ws
            for a in ws:
                near[a].add(key[1])
    form = {}
    for w, ws in near.items():
        best = min(ws, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def result(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    want = brute(brute_counts(docs))
    assert any(r[1] for r in want) and any(r[4] for r in want)
    assert result(op12_spelling_variants(spark, SF_MID)) == want


def test_crowded_vocabulary_in_split_subtrees(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abeinqé×") for _ in range(rng.randint(5, 7))) for _ in range(3000)}
    counts = {w: rng.choice([3, 4, 6, 12, 50, 200]) for w in words}
    got = variants.near_pairs(spark.createDataFrame(list(counts.items()), "word string, n long"), subtree_words=40).collect()
    pairs = [frozenset((r["a"], r["b"])) for r in got]
    assert len(pairs) == len(set(pairs))
    near = Counter(w for p in pairs for w in p)
    assert {w: near[w] for w in counts} == {r[0]: r[4] for r in brute(counts)}


def test_forms_are_followed_to_the_last(spark):
    text = " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aabbb"] * 24 + ["abbbb"] * 48 + ["bbbbb"] * 96)
    docs = [(k, text if k == 1 else None) for k in range(3)]
    got = {r["word"]: (r["form"], r["root"]) for r in variants.variant_groups(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {w: r for w, (_, r) in got.items()} == {r[0]: r[2] for r in brute(brute_counts(docs))}
    assert got["aaaaa"] == ("aaaab", "bbbbb")


def test_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert result(variants.variant_groups(odd_docs)) == brute(brute_counts(rows))
    assert variants.variant_groups(no_docs).collect() == []


def test_blocks_cut_no_run():
    text = "Some words, " * 40 + "x" * 200 + "é end"
    parts = list(variants.blocks(text, 50))
    assert "".join(parts) == text and len(parts) > 5
    assert [w for p in parts for w in re.findall("[A-Za-zÀ-ÿ]+", p)] == re.findall("[A-Za-zÀ-ÿ]+", text)


def test_a_text_of_many_megabytes(spark):
    text = "steady words stand here " * 1_500_000
    got = {r["word"]: r["n"] for r in variants.variant_groups(spark.createDataFrame([(5, text)], "doc_id long, text string")).collect()}
    assert got == brute_counts([(5, text)])


def test_deep_trie(monkeypatch):
    """Branches at every level, and every split between key and trie."""
    monkeypatch.setattr(variants, "BUCKET", 2)
    rng = random.Random(11)
    words = sorted({"".join(rng.choice("aeinqé") for _ in range(rng.randint(5, 6))) for _ in range(500)})
    want = brute({w: 3 for w in words})
    for top in (2, 4, 8):
        tries = defaultdict(lambda: variants.Trie(top))
        for w in words:
            tries[",".join(map(str, [len(w), *variants.vector(w)[:top]]))].add(w, 3)
        for t in tries.values():
            t.seal()
        pairs = [frozenset((w, o)) for w in words for key, spent, insert in variants.searches(w, top) if key in tries
                 for o, _ in tries[key].search(w, spent, insert)]
        assert len(pairs) == len(set(pairs))
        near = Counter(w for p in pairs for w in p)
        assert {w: near[w] for w in words} == {r[0]: r[4] for r in want}
