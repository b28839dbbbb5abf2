"""Repeated passages of words (operator 6) against brute force."""

import random
import re
import time

import numpy as np
import pyarrow as pa
from llm_data import SF_SMALL, odd_docs  # noqa: F401
from sparkscout.llm import passages, queries
from sparkscout.llm.base import table


def _gone(rows, least):
    """Places of the words in a run of ``least`` words that stands earlier."""
    seen, out = set(), {}
    for k, text in sorted(rows):
        words, gone = text.split(), set()
        for i in range(len(words) - least + 1):
            run = tuple(words[i:i + least])
            if run in seen:
                gone |= set(range(i, i + least))
            seen.add(run)
        out[k] = [w for i, w in enumerate(words) if i not in gone]
    return out


def test_planted_passages(spark):
    rng = random.Random(11)

    def prose(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]
    p, tail = prose(60), prose(9)
    rows = [(1, " ".join(prose(30) + p + prose(20))),                             # inside one line
            (2, " ".join(["a", "b", *p, "c"]) + "\r\n\nnext line"),               # inside another line
            (3, "before\n" + "\n".join(" ".join(p[i:i + 7]) for i in range(0, 60, 7)) + "\n\nafter"),
            (4, " ".join(["x", *p[:49], "y"])),                                   # a word too short
            (5, " ".join(["x", *p[5:55], *tail])),                                # ends inside the passage
            (6, "u  " + " ".join(p) + "  v\n \n" + " ".join(p[:50]))]
    got = {r["doc_id"]: r for r in passages.dedup_passages(
        spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    want = {1: rows[0][1], 2: "a b c\r\n\nnext line", 3: "before\n\nafter", 4: rows[3][1], 5: " ".join(["x", *tail]),
            6: "u  v\n "}
    assert {k: r["text"] for k, r in got.items()} == want
    assert [got[k]["n_deleted_words"] for k in sorted(got)] == [0, 60, 60, 0, 50, 110]
    assert [got[k]["n_deleted_lines"] for k in sorted(got)] == [0, 0, 9, 0, 0, 1]


def test_random_words_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(12)] + ["", " "]
    rows = [(k, rng.choice("\n ").join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for k in range(60)]
    rows += [(100, "a " * 40), (101, "b\n" * 30 + "a " * 12)]
    for least in (1, 2, 10):
        got = passages.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
        assert {r["doc_id"]: r["text"].split() for r in got} == _gone(rows, least)


def test_op6_deletes_passages(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF_SMALL, "documents").collect()]
    got = queries.op6_line_dedup(spark, SF_SMALL).collect()
    want = _gone(rows, 50)
    assert {r["doc_id"]: r["text"].split() for r in got} == want
    assert sum(r["n_deleted_words"] for r in got) == sum(len(t.split()) - len(want[k]) for k, t in rows)


def test_odd_rows(odd_docs):  # noqa: F811
    before = [r["text"] for r in odd_docs.select("text").collect()]
    got = passages.dedup_passages(odd_docs, 50).collect()
    assert len(got) == len(before)
    assert sum(r["text"] is None for r in got) == sum(t is None for t in before)
    empty = passages.dedup_passages(odd_docs.filter("false"), 50)
    assert empty.count() == 0


def test_word_hashes_equal_split():
    rng = random.Random(5)
    signs = list("ab \n\t\r\x1c\x0b") + ["\u00a0", "\u2003", "\x85", "é", "日", "🙂", "\x00", "word", "w" * 70_000]
    texts = ["", " ", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(200))]
    hashes, sizes = passages.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert sizes.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
    of = {}
    for w, h in zip(words, hashes.tolist()):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)


def test_a_long_text_in_blocks(spark):
    """Passages over the edges of blocks, inside one long text and between texts."""
    rng = random.Random(8)
    n = passages.CHUNK
    words = [f"w{rng.randrange(10**9)}" for _ in range(3 * n)]
    words[2 * n + 500:2 * n + 700] = words[n - 100:n + 100]
    other = ["x", "y"] + words[n - 30:n + 40] + ["z"] + words[2 * n - 25:2 * n + 25]
    rows = [(1, " ".join(words)), (2, " ".join(other))]
    got = {r["doc_id"]: r for r in passages.dedup_passages(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    assert got[1]["text"].split() == words[:2 * n + 500] + words[2 * n + 700:]
    assert got[2]["text"] == "x y z" and got[2]["n_deleted_words"] == 120


def test_a_text_of_many_megabytes(spark):
    text = " ".join(str(k) for k in range(4_000_000))
    rows = [(1, text), (2, "a " + text[-5000:])]
    got = {r["doc_id"]: r["n_deleted_words"] for r in passages.dedup_passages(
        spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    assert got[1] == 0 and got[2] == len(text[-5000:].split()) - (" " not in text[-5001:-4999])


def test_rewrite_keeps_columns(spark):
    p = " ".join(f"p{k}" for k in range(60))
    rows = [(1, p, "en", 5), (2, f"before {p} after", "fr", 9), (None, None, None, None), (None, "x " + p, "en", 0)]
    got = passages.rewrite(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long"), 50)
    assert got.columns == ["doc_id", "text", "lang", "n_chars"]
    # rows without id come first
    want = [(None, None, None, None), (None, "x " + p, "en", 0), (1, "", "en", 0), (2, "before after", "fr", 12)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def _cut_plainly(text, runs):
    """Word by word and line by line what :func:`passages.delete_runs` does at once."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    gone = {w for i, j in runs for w in range(i, j + 1)}
    inside = {w for i, j in runs for w in range(i, j)}
    kept, k, start = [], 0, 0
    for line in text.split("\n"):
        end, first = start + len(line), k
        while k < len(spans) and spans[k][0] < end:
            k += 1
        here = [w in gone for w in range(first, k)]
        if not (all(here) if here else first - 1 in inside):
            out, at, i = "", start, first
            while i < k:
                j = i
                while j < k and j in gone:
                    j += 1
                if j > i:
                    out += text[at:spans[i][0] if j < k else spans[i - 1][1]]
                    at = spans[j][0] if j < k else spans[j - 1][1]
                i = j + 1
            kept.append(out + text[at:end])
        start = end + 1
    return "\n".join(kept), text.count("\n") + 1 - len(kept), len(gone)


def test_texts_cut_together_as_one_by_one():
    rng = random.Random(5)
    gaps = [" ", " ", "  ", "\n", "\n\n", " \n", "\r\n", "\t", "\x1c", "\x85", " ", "  ", "　\n"]
    texts, runs = [], []
    for _ in range(1500):
        words = [rng.choice(["a", "bc", "é", "日本", "😀x"]) for _ in range(rng.randint(1, 25))]
        texts.append(rng.choice(["", *gaps]) + "".join(w + rng.choice(gaps) for w in words))
        texts[-1] = texts[-1].rstrip() if rng.random() < 0.5 else texts[-1]
        at = [rng.randrange(len(words)) for _ in range(rng.randint(0, 3))]
        runs.append([(i, rng.randint(i, len(words) - 1)) for i in at])
    flat = np.asarray([(k, i, j) for k, rs in enumerate(runs) for i, j in rs], np.int64).T
    out, lines, words = passages.delete_runs(texts, *flat)
    want = [_cut_plainly(t, r) for t, r in zip(texts, runs)]
    assert list(zip(out.to_pylist(), lines.tolist(), words.tolist())) == want
    assert [passages.delete_words(t, r) for t, r in zip(texts[:200], runs)] == want[:200]


def test_cutting_costs_less_than_word_by_word():
    """Seconds of the last stage: the texts are cut together, not one by one."""
    rng = random.Random(6)
    texts = ["\n".join(" ".join(f"w{rng.randrange(999)}" for _ in range(12)) for _ in range(25)) for _ in range(1000)]
    deleted = [[{"first": 30, "last": 90}, {"first": 200, "last": 255}]] * len(texts)
    runs = pa.array(deleted, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))
    column = pa.array(texts)
    at = time.process_time()
    want = [_cut_plainly(t, [(30, 90), (200, 255)]) for t in texts]
    plain, at = time.process_time() - at, time.process_time()
    out, lines, words = passages._cleaned(column, runs)
    assert time.process_time() - at < plain / 2
    assert list(zip(out.to_pylist(), lines.tolist(), words.tolist())) == want


def test_null_texts_and_texts_without_runs_stay():
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    texts = pa.array([None, "", "a b c", "a b c", None, "x"])
    runs = pa.array([None, None, None, [{"first": 1, "last": 1}], [], [{"first": 0, "last": 0}]], kind)
    for lo in (0, 1):
        out, lines, words = passages._cleaned(texts.slice(lo), runs.slice(lo))
        assert out.to_pylist() == [None, "", "a b c", "a c", None, ""][lo:]
        assert lines.tolist() == [0, 0, 0, 0, 0, 1][lo:] and words.tolist() == [0, 0, 0, 1, 0, 1][lo:]
