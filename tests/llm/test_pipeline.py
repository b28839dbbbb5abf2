"""The whole pipeline against a plain Python version of every stage."""

import zlib

import numpy as np

import corpus_pipeline
from llm_data import SF_SMALL
from sparkscout.llm import langid, packing, passages, toxicity
from sparkscout.llm.base import crc_mod, table
from sparkscout.llm.tokenizing import public_path
from test_exact import _fingerprint, _library, _roots


def _language(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    model = langid.learn(df.filter(crc_mod("doc_id", 5) != 0), public_path("piece_bpe_32k.model"))
    names, scores = langid.decide(langid.Scorer(model), [r["text"] for r in rows])
    return [r for r, name, s in zip(rows, names, scores) if name != "und" and s >= 0.5]


def _toxicity(spark, rows, schema):
    labels = table(spark, SF_SMALL, "labels").filter(crc_mod("doc_id", 3) != 1)
    model = toxicity.learn(spark.createDataFrame(rows, schema), labels)
    features, kept = toxicity.Features(model.features), []
    for r in rows:
        x = np.zeros(len(model.weight))
        found, dense = features.of(r["text"])
        x[found] = 1.0
        x[len(model.features):] = dense
        if 1 / (1 + np.exp(-x @ model.weight)) < 0.7:
            kept.append(r)
    return kept


def _passages(rows, least):
    """Texts without the runs of ``least`` words that stand earlier, every
    window of every text compared."""
    seen, out = set(), {}
    for k, text in sorted(rows):
        words, runs = text.split(), []
        for i in range(len(words) - least + 1):
            window = tuple(words[i:i + least])
            if window in seen:
                runs.append((i, i + least - 1))
            seen.add(window)
        out[k] = passages.delete_words(text, runs)[0]
    return out


def test_pipeline_against_plain_python(spark):
    docs = table(spark, SF_SMALL, "documents")
    rows = _toxicity(spark, _language(spark, docs.collect(), docs.schema), docs.schema)
    texts = _passages([(r["doc_id"], r["text"]) for r in rows], 50)
    fp = {k: _fingerprint(t) for k, t in texts.items()}
    roots = _roots(sorted(texts), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    want = set()
    for k in texts:
        if roots[k] == k:
            ids = np.asarray([*_library("byte_bpe_50k.json").encode(texts[k], add_special_tokens=False).ids, 2], "<u4")
            at = 0
            for piece, n in enumerate(packing.cut_lengths(len(ids), 1024)):
                want.add((k, piece, at, n, zlib.crc32(ids[at:at + n].tobytes())))
                at += n
    got = corpus_pipeline.run(spark, SF_SMALL).toPandas()
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    assert len(got) == len(want)
    q = got.sort_values(["sequence_id", "offset"])
    ends = q.groupby("sequence_id").length.cumsum()
    assert (ends - q.length == q.offset).all() and ends.max() <= 1024


def test_stages_by_name_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "line_dedup", "simhash_near_dedup",
                                                     "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None
