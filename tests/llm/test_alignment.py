"""Cross-tokenizer alignment against a brute-force comparison of byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm_data import SF_SMALL, labels, no_docs, odd_docs, paths  # noqa: F401
from sparkscout.llm import alignment
from sparkscout.llm.queries import op13_token_alignment

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def sides(paths):
    tok = Tokenizer.from_file(paths["byte"])
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=paths["piece"])
    letters = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    code = {chr(b): b for b in letters}
    code |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in letters)}

    def encode(text):
        a = tok.encode(" " + text, add_special_tokens=False)
        left = list(zip(a.ids, (bytes(code[c] for c in t) for t in a.tokens)))
        right = [(i, bytes([int(p[3:-1], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode())
                 for i, p in ((i, model.id_to_piece(i)) for i in model.encode(text))]
        want = (" " + text).encode()
        if any(b"".join(t for _, t in side) != want for side in (left, right)):
            return None
        return left, right
    return encode


def ranges(side):
    at, out = 0, []
    for i, data in side:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute(rows, sides):
    """The result rows of (doc_id, text), all token pairs near each other compared."""
    found, counts = [], Counter()
    for _, text in rows:
        both = sides(text) if text else None
        if both is None:
            found.append(None)
            continue
        a, b = map(ranges, both)
        links, lo = [], 0
        for i, s, e in a:
            while lo < len(b) and b[lo][2] <= s:
                lo += 1
            k = lo
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        counts.update(links)
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        cut_a, cut_b, start, x, y = [], [], 0, 0, 0
        for end in ends:
            cut_a.append([]), cut_b.append([])
            while x < len(a) and a[x][2] <= end:
                cut_a[-1].append(str(a[x][0]))
                x += 1
            while y < len(b) and b[y][2] <= end:
                cut_b[-1].append(str(b[y][0]))
                y += 1
        text = ";".join(f"{','.join(p)}|{','.join(q)}" for p, q in zip(cut_a, cut_b))
        found.append((len(a), len(b), len(ends), links, hashlib.sha256(text.encode()).hexdigest()))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for (doc_id, _), f in zip(rows, found):
        out.append((doc_id, 0, 0, 0, 0, 0, 0, "") if f is None else (
            doc_id, f[0], f[1], f[2], len(f[3]), sum(counts[p] == most[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]))
    return out


def result(df):
    return Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in df.collect())


def test_query_against_brute_force(spark, sides):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert result(op13_token_alignment(spark, SF_SMALL)) == Counter(brute(rows, sides))


def test_odd_rows(odd_docs, no_docs, paths, sides):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert result(alignment.cross_alignment(odd_docs, paths["byte"], paths["piece"])) == Counter(brute(rows, sides))
    assert alignment.cross_alignment(no_docs, paths["byte"], paths["piece"]).collect() == []


def test_strange_texts_and_the_join_by_shuffle(spark, paths, sides, monkeypatch):
    rng = random.Random(4)
    signs = list("ab eé日🙂\n\t  ▁ \x00'sl1९") + ["<|endoftext|>", "<s>", "</s>", " the", "ing", "\r\n", "<0x41>"]
    rows = [(k, "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))) for k in range(300)]
    rows += [(900, "two▁words"), (901, "<|endoftext|>"), (902, " "), (903, "é and é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(brute(rows, sides))
    assert sum(r[-1] == "" for r in want) > 1
    assert result(alignment.cross_alignment(df, paths["byte"], paths["piece"])) == want
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    assert result(alignment.cross_alignment(df, paths["byte"], paths["piece"])) == want


def test_parts_of_a_long_text(paths, sides):
    rng = random.Random(9)
    words = ["the", "cat's", "naïve", "12345", "日本語", "two  spaces", "line\nbreak", "end."]
    text = " ".join(rng.choice(words) for _ in range(4000))
    al = alignment.Aligner(paths["byte"], paths["piece"])
    cut = list(alignment.parts(text, 700))
    assert " ".join(cut) == text and len(cut) > 20
    doc = alignment._Document()
    for p in alignment.align(al, cut):
        doc.add(p)
    got = doc.result()
    want = brute([(1, text)], sides)[0]
    assert got[:4] == want[1:5] and got[4] == want[7]
    whole = alignment.align(al, [text])[0]
    assert np.array_equal(whole[5], got[5]) and np.array_equal(whole[6], got[6])


def test_both_sides_share_one_cut(paths, monkeypatch):
    texts = ["the cat\nsat on", "", "two  spaces", "naïve end.", "the cat", "two▁words", " the", "日本語 1234"] * 4
    al = alignment.Aligner(paths["byte"], paths["piece"])
    want = [alignment.align(al, [t])[0] for t in texts]
    cuts, cut = [], alignment.cut_words
    monkeypatch.setattr(alignment, "cut_words", lambda lines: cuts.append(lines) or cut(lines))
    monkeypatch.setattr(alignment, "GROUP_CHARS", 20)          # encoded together, aligned in small groups
    got = alignment.align(al, texts)
    assert len(cuts) == 1 and len(got) == len(texts)
    for g, w in zip(got, want):
        assert (g is None) == (w is None)
        assert g is None or g[:5] == w[:5] and all(np.array_equal(a, b) for a, b in zip(g[5:], w[5:]))


def test_a_text_of_many_megabytes(spark, paths):
    line = "A longer text, with some words of several lengths; and numbers 1024.\n"
    df = spark.createDataFrame([(1, line * 120_000), (2, line)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.cross_alignment(df, paths["byte"], paths["piece"]).collect()}
    assert got[1]["n_links"] > 115_000 * got[2]["n_links"] and got[1]["groups_sha256"]
