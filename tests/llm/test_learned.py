"""Operators that learn or approximate: held-out accuracy, recall, counts
against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_data import SF_MID, SF_SMALL, odd_docs, paths  # noqa: F401
from sparkscout.llm import html_blocks, langid, nndescent, quality, queries, toxicity
from sparkscout.llm.base import table


@pytest.fixture(scope="module")
def labeller():
    return html_blocks.trained()


def test_generated_pages_are_labelled(labeller):
    rng = random.Random(99)
    made = [html_blocks.generated_page(rng) for _ in range(200)]
    got = labeller.label([html_blocks.page_matrix(b) for b, _ in made])
    assert np.mean(np.concatenate([g == np.asarray(y) for g, (_, y) in zip(got, made)])) > 0.985


def test_page_parts(labeller):
    html = """<html><body><header><div class="logo">Site</div></header><nav><a href="/">Home</a></nav>
    <div class="cookie-notice">We use cookies.</div><article class="post"><h1>T  i&amp;tle</h1><p>One<br>two.
    <p>Three &lt;b&gt; <b>four</b>&nbsp;five</p><div class="ad">Buy now.</div><script>var x = "</p>";</script>
    <form><label>Mail</label></form></article><section class="comments"><p>I like this text a lot.</p></section>
    <footer>&copy; Site</footer></body></html>"""
    assert html_blocks.main_text([html, None, "", "<script>x"], labeller) == [
        "T i&tle\nOne two.\nThree <b> four five", "", "", ""]


@pytest.mark.parametrize("html", ["<", "<a", "<p", "</", "<!--", "<p class='", "a < b", "<>", "<p>x</q></p>", "&#x0;&bad;",
                                  "<div " * 2000, "<p>" * 3000 + "x", "<" * 20_000])
def test_broken_html(html):
    assert isinstance(html_blocks.blocks(html), list)


def test_op1_takes_the_article(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, SF_SMALL, "pages").collect()}
    got = queries.op1_html_text(spark, SF_SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        m = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)
        want = [x[1] for x in html_blocks.blocks(m[1])]
        assert r["text"] == "\n".join(want) and r["n_chars"] == len(r["text"])


def test_forward_pass_sums_all_segmentations(paths):
    lattice = langid.lattice_of(paths["piece"])
    p = np.random.default_rng(0).random((lattice.size, 3))
    p /= p.sum(axis=0)

    def total(word):
        if not word:
            return np.ones(3)
        out = np.zeros(3)
        for e in range(1, min(len(word), lattice.longest) + 1):
            k = lattice.ids.get(word[:e], 0 if e == 1 else None)
            if k is not None:
                out += p[k] * total(word[e:])
        return out
    for w in ("the", "étions", "日本", "zzqx"):
        want = np.log(total(langid.MARK + w))
        assert np.allclose(lattice.log_likelihood([langid.MARK + w], p)[0], want)
        assert np.allclose(lattice._long(langid.MARK + w, p), want)
    long = lattice.log_likelihood([langid.MARK + "nation" * 3000], p)
    assert np.isfinite(long).all() and (long < -10_000).all()


class _Counting(dict):
    """Counts the look-ups by ``get``."""

    asked = 0

    def get(self, *args):
        self.asked += 1
        return super().get(*args)


def test_table_walks_all_words_at_once(paths):
    lattice = langid.Lattice(langid.vocabulary(paths["piece"]))
    reach = lattice.reach
    words = [langid.MARK + w for w in ("the", "straße", "a", "qqzzx", "internationalisation", "eé" * 12, "\U0001d51e", "the")]
    rare = [langid.MARK + w for w in ("日本語", "the日", "ﬀ")]

    def plain(some):
        return sorted((e, s, r, max(reach.get(w[s:e], 0), 0)) for r, w in enumerate(some) for s in range(len(w))
                      for e in range(s + 1, len(w) + 1) if e == s + 1 or reach.get(w[s:e], 0) > 0)

    def flat(some):
        groups = lattice.table(some)
        assert [g[:2] for g in groups] == sorted({g[:2] for g in groups})
        assert all((np.diff(g[2]) > 0).all() for g in groups)
        return [(e, s, r, k) for e, s, rows, ids in groups for r, k in zip(rows.tolist(), ids.tolist())]

    lattice.reach = _Counting(reach)
    assert flat(words) == plain(words)
    assert lattice.reach.asked == 0              # no dictionary for words of common characters
    assert flat(words + rare + words) == plain(words + rare + words)
    assert flat([]) == []


def test_expected_counts_add_up(paths):
    lattice = langid.lattice_of(paths["piece"])
    p = np.full((lattice.size, 1), 1 / lattice.size)
    words = ["▁nation", "▁a"]
    counts = lattice.expected(words, np.asarray([[2.0], [1.0]]), p)
    size = np.asarray([0.0] + [len(x) for x in lattice.ids])
    size[0] = 1
    assert np.isclose((counts[:, 0] * size).sum(), 2 * 7 + 2)


def test_op4_held_out(spark):
    got = queries.op4_language_id(spark, SF_MID).join(table(spark, SF_MID, "documents"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_und(spark, paths):
    model = langid.Model(paths["piece"], ["en", "fr"], np.full((langid.lattice_of(paths["piece"]).size, 2), 1e-4))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "word")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).collect()}
    assert got == {1: ("und", 0.0), 2: ("und", 0.0), 3: ("und", 0.0), 4: ("en", 0.5)}
    assert [r["doc_id"] for r in langid.filter_rows(docs, model).collect()] == [4]


def test_label_model_outvotes_wrong_marks():
    """Where marks only start the voters' rates, rows with a flipped mark get
    the posterior of their votes."""
    rng = np.random.default_rng(2)
    label = (rng.random(4000) < 0.2).astype(int)
    votes = np.column_stack([np.where(label, rng.random(4000) < 0.7, rng.random(4000) < 0.03) for _ in range(8)]).astype(int)
    flipped = rng.random(4000) < 0.05
    mark = np.where(flipped, 1 - label, label)
    q = toxicity.fit_label_model(votes, np.where(mark > 0, 0.95, 0.05)).posterior(votes)
    assert ((q > 0.5) == label)[flipped].mean() > 0.9 and ((q > 0.5) == mark)[flipped].mean() < 0.1
    assert ((q > 0.5) == label).mean() > 0.97


def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.2
    good = [np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.02) for _ in range(3)]
    noise = rng.random(4000) < 0.3
    votes = np.column_stack([*good, good[0], noise]).astype(int)      # the fourth repeats the first
    model = toxicity.fit_label_model(votes, votes[:, :3].mean(axis=1).clip(0.05, 0.95))
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.95
    precision = model.precision(votes)
    assert min(precision[:3]) > 0.8 and precision[4] < 0.4


def test_op3_held_out(spark):
    got = queries.op3_toxicity(spark, SF_MID).join(table(spark, SF_MID, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    order = held.sort_values("score").reset_index(drop=True)
    ones = order.index[order.toxic == 1] + 1
    n1, n0 = len(ones), len(held) - len(ones)
    assert (ones.to_numpy().sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.85
    assert held[held.toxic == 0].predicted.mean() < 0.02


def test_op5_recall(spark):
    got = queries.op5_nn_descent(spark, SF_SMALL).toPandas()
    rows = table(spark, SF_SMALL, "embeddings").toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    hits = []
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11))
        assert np.allclose(own.score, [d[ids == v][0] for v in own.vec_id], rtol=1e-12)
        hits.append(len(set(own.vec_id) & set(ids[order])) / 10)
    assert np.mean(hits) >= 0.9


def test_graph_on_clustered_vectors(spark):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(8, 12)), 60, axis=0) + 0.1 * rng.normal(size=(480, 12))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nndescent.nearest(df, F.col("id") % 20 == 0, k=5).toPandas()
    hits = [len(set(g.vec_id) & set(np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:6])) / 5
            for q, g in got.groupby("query_id")]
    assert np.mean(hits) >= 0.95


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def test_op8_counts(spark, odd_docs):
    got = queries.op8_quality_divergence(spark, SF_SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF_SMALL, "documents").collect()}
    assert len(got) == len(texts)
    for r in got:
        base = _base(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r["base_failed"] and r["kept"])
    odd = {r["doc_id"]: r["text"] or "" for r in odd_docs.filter("doc_id is not null and doc_id <> 5").collect()}
    for r in quality.quality_verdict(odd_docs.filter("doc_id is not null and doc_id <> 5")).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == _base(
            odd[r["doc_id"]])


def test_js_distance(spark):
    row = spark.sql("select array(0.5D, 0.5D, 0D) p, array(0D, 0D, 1D) q").select(
        quality.js_distance(F.col("p"), F.col("q")).alias("far"),
        quality.js_distance(F.col("p"), F.col("p")).alias("same")).first()
    assert (row["far"], row["same"]) == (1.0, 0.0)


def test_op8_is_native(spark):
    plan = queries.op8_quality_divergence(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_groups_are_never_cut():
    import pyarrow as pa
    v = np.repeat(np.arange(40), np.random.default_rng(2).integers(1, 9, 40))
    for size in (1, 3, 7, 500):
        batches = [pa.RecordBatch.from_arrays([pa.array(v[k:k + size])], ["v"]) for k in range(0, len(v), size)]
        parts = [t.column("v").to_numpy() for t in nndescent.whole_groups(iter(batches), "v")]
        assert np.array_equal(np.concatenate(parts), v)
        for a, b in zip(parts, parts[1:]):
            assert a[-1] != b[0]


def test_op8_keeps_clean_documents(spark):
    got = queries.op8_quality_divergence(spark, SF_MID).join(table(spark, SF_MID, "labels"), "doc_id").toPandas()
    tried = got[~got.base_failed]
    assert tried[tried.quality == 1].kept.mean() > 0.99
    assert tried[tried.quality == 0].kept.mean() < 0.1
