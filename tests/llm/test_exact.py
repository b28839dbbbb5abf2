"""Operators with one right answer, against brute force or the reference
library."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_data import SF_SMALL, paths  # noqa: F401
from sparkscout.llm import bpe, packing, queries, simhash, tokenstore
from sparkscout.llm.base import scratch_path, table
from sparkscout.llm.components import components
from sparkscout.llm.tokenizing import ChunkEncoder, SeenTwice

TEXT = st.lists(st.one_of(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n'\tabé1.!#")),
                                   max_size=40),
                           st.sampled_from(["<|endoftext|>", " <|startoftext|> ", "<|ENDOFTEXT|>", " word", "\nline"])),
                 max_size=4).map("".join)
_TOK = {}


def _library(name):
    if name not in _TOK:
        _TOK[name] = Tokenizer.from_file(P.path(name))
    return _TOK[name]


def _tiktoken():
    if "t" not in _TOK:
        ranks = {base64.b64decode(a): int(b) for a, b in
                 map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
        _TOK["t"] = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _TOK["t"]


def _docs(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF_SMALL, "documents").collect()}


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_chunk_encoders_equal_the_library(texts):
    for name, spaces in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        own = _TOK.setdefault(("own", name), ChunkEncoder(P.path(name), spaces))
        want = [e.ids for e in _library(name).encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_many(texts)] == want


def test_a_group_asks_once_for_each_word():
    """Words that come up in many texts are learned once; letters of Latin-1,
    composed ones and others are the library's, in both kinds of file."""
    odd = "straße ñandú µm ªº Àé e\u0301té İstanbul ſo ǅ x² n'est ÿ,,\nØre don't \u00a0a"
    texts = [f"shared words{chr(97 + k % 26)}, {odd}" for k in range(300)] + ["", "plain\ntext", "<|endoftext|> a", None]
    for name, spaces in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        own, learned = ChunkEncoder(P.path(name), spaces), []
        learn = own._learn
        own._learn = lambda missing, learn=learn, learned=learned: (learned.extend(missing), learn(missing))
        want = [e.ids for e in _library(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_many(texts)] == want
        assert len(learned) == len(set(learned)) and not set(learned) & {"<|endoftext|>"}


def test_cache_keeps_what_came_up_twice():
    cache = SeenTwice(10)
    for group in (["a", "b"], ["b", "c"], ["d"]):
        new = cache.missing(set(group))
        cache.known.update(dict.fromkeys(new, b"x"))
        cache.settle(new)
    assert list(cache.known) == ["b"]


def test_a_few_million_characters_are_one_group(paths, monkeypatch):
    enc, groups = ChunkEncoder(paths["word"], False), []
    monkeypatch.setattr(enc, "encode_group", lambda g: groups.append(len(g)) or [b""] * len(g))
    assert len(list(enc.encode_many(["some words " * 1000] * 600))) == 600
    assert groups == [600]


def test_special_tokens_in_texts():
    """As the library has them, or as plain text where that is asked for."""
    text = "hello <|endoftext|> world <|startoftext|>"
    for name, spaces, n, plain in (("word_bpe_49k.json", False, 4, 15), ("byte_bpe_50k.json", True, 11, 16)):
        assert len(ChunkEncoder(P.path(name), spaces).encode(text)) // 4 == n
        assert len(ChunkEncoder(P.path(name), spaces, plain_special=True).encode(text)) // 4 == plain


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_bpe_equals_tiktoken(text):
    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == _tiktoken().encode_ordinary(text)
    assert codec.decode(ids).decode() == text


def test_bpe_long_pre_tokens():
    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = random.Random(2)
    for text in ("a" * 9000, " " * 5000, "".join(rng.choice("abcde") for _ in range(20_000))):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == _tiktoken().encode_ordinary(text)


class _Counting(dict):
    """Counts the look-ups by ``get``."""

    asked = 0

    def get(self, *args):
        self.asked += 1
        return super().get(*args)


def test_merging_looks_up_grown_spans_only():
    codec = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    ranks, short = _Counting(codec.ranks), bpe.short_ranks(codec.ranks)
    for piece in (" unforeseeableness", "ein Wort", "zxqj", "aaaaaaaaaa", "日本語", "\x00\xff"):
        data, ranks.asked = piece.encode(), 0
        ids = bpe.merge_piece(data, ranks, *short)
        assert b"".join(codec.tokens[i] for i in ids) == data
        assert ranks.asked <= 1 + 2 * (len(data) - len(ids))   # itself, and two pairs a merge


def test_bpe_groups_cut_by_arrow():
    codec = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = ["one two\nthree", "", None, " two  one", "two", "one\ttwo three", "'s one\n\nx", "日本 two\none."] * 3
    asked = []
    split, codec.split = codec.split, lambda t: asked.append(t) or split(t)
    got = list(codec.encode_many(texts))
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == _tiktoken().encode_ordinary(t or "")
    assert asked.count(" two") == 1 and asked.count("\nthree") == 1


def test_rank_queue_pops_in_order():
    rng, queue = random.Random(1), bpe.RankQueue()
    pairs = [(rng.randrange(50_000), rng.randrange(100)) for _ in range(2000)]
    for r, p in pairs:
        queue.push(r, p)
    assert [queue.pop() for _ in pairs] == sorted(pairs)
    assert queue.pop() is None


def test_op10(spark):
    docs = _docs(spark)
    for r in queries.op10_byte_bpe(spark, SF_SMALL).collect():
        ids = np.asarray(_tiktoken().encode_ordinary(docs[r["doc_id"]]), "<u4").tobytes()
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_op7(spark):
    docs, at = _docs(spark), 0
    got = {r["doc_id"]: r for r in queries.op7_token_store(spark, SF_SMALL).collect()}
    for k in sorted(docs):
        ids = np.asarray([*_library("word_bpe_49k.json").encode(docs[k], add_special_tokens=False).ids, 2], "<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_store_lookup_of_some_and_unknown_keys(spark, paths):
    docs = spark.createDataFrame([(k, "x " * k) for k in range(0, 60, 2)], "doc_id long, text string")
    path = scratch_path(spark, "store")
    tokenstore.write_store(docs, path, paths["word"], 2, False)
    asked = spark.createDataFrame([(k,) for k in (58, 3, 4, -1, 1000)], "doc_id long")
    got = {r["doc_id"]: r for r in tokenstore.lookup(asked, path, with_ids=True).collect()}
    assert got[4]["n_tokens"] == 5 and got[4]["ids"][-1] == 2 and len(got[58]["ids"]) == 59
    assert all(got[k]["n_tokens"] is None and got[k]["ids"] is None for k in (3, -1, 1000))


def test_perfect_hash_is_minimal():
    keys = [f"doc-{k}" for k in range(5000)]
    h = tokenstore.key_hashes(keys)[:, 0]
    mph = tokenstore.PerfectHash.build(h)
    assert sorted(mph.slots(h).tolist()) == list(range(5000))


def test_op9(spark):
    docs = _docs(spark)
    got = queries.op9_best_fit_packing(spark, SF_SMALL).toPandas().sort_values(["doc_id", "piece"])
    for k, g in got.groupby("doc_id"):
        ids = np.asarray([*_library("byte_bpe_50k.json").encode(docs[k], add_special_tokens=False).ids, 2], "<u4")
        assert g.length.sum() == len(ids)
        for r in g.itertuples():
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    q = got.sort_values(["sequence_id", "offset"])
    ends = q.groupby("sequence_id").length.cumsum()
    assert (ends - q.length == q.offset).all() and ends.max() <= 1024
    assert got.sequence_id.nunique() <= 1.02 * np.ceil(got.length.sum() / 1024) + 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_places_every_length_once(histogram):
    fill, placed = {}, {}
    for n, count, first, used in packing.plan_runs(histogram, 40):
        placed[n] = placed.get(n, 0) + count
        for s in range(first, first + count):
            fill.setdefault(s, []).append((used, n))
    assert placed == histogram
    for items in fill.values():
        at = 0
        for used, n in sorted(items):
            assert used == at
            at += n
        assert at <= 40
        assert sum(3 * n > 40 for _, n in items) <= 2


def test_sequences_hold_the_ids(spark, paths):
    docs = spark.createDataFrame([(k, "some words " * (k % 7)) for k in range(30)], "doc_id long, text string")
    cut = packing.pieces(docs, paths["byte"], 2, 16, keep_ids=True)
    got = packing.sequences(packing.pack(cut, 16)).collect()
    assert sum(len(r["ids"]) for r in got) == cut.selectExpr("sum(length)").first()[0]
    assert max(len(r["ids"]) for r in got) <= 16


def _fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _roots(values, near):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_op2(spark):
    docs = _docs(spark)
    fp = {k: _fingerprint(t) for k, t in docs.items()}
    want = _roots(sorted(docs), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    for r in queries.op2_simhash(spark, SF_SMALL).collect():
        assert int(r["fingerprint"], 16) == fp[r["doc_id"]]
        assert r["component_id"] == want[r["doc_id"]]


def test_covering_masks_leave_no_pair_out():
    rng, masks = random.Random(4), simhash.covering_masks(4)
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & flip for m in masks)


def test_links_with_tiny_buckets_lose_no_component(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)})
    fps = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    want = _roots(values, lambda a, b: (a ^ b).bit_count() <= 4)
    classes = len(set(want.values()))
    for most in (2, 3, 10_000):
        got = {r["v"]: r["root"] for r in components(simhash.links(fps, 4, most)).collect()}
        label = {v: got.get(simhash._signed(v), simhash._signed(v)) for v in values}
        assert len(set(label.values())) == classes
        assert all((label[a] == label[b]) == (want[a] == want[b]) for a in values for b in values)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    got = {r["v"]: r["root"] for r in components(edges).collect()}
    assert {got[k] for k in range(201)} == {0} and got[501] == 500
