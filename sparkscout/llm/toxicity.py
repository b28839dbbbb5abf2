"""Toxicity by weak supervision (operator 3).

1. *Voters.*  Words, word beginnings and word endings that come much more
   often in documents marked toxic than in others are found by counts over
   the sample rows; a public list of insults and a few writing patterns
   (shouting, long runs of exclamation marks, insults aimed at "you") add
   voters that need no labels.  A voter fires or abstains.
2. *Label model.*  A generative model of the hidden label and all voters is
   fitted by expectation maximisation.  Voters depend on the label and on one
   other voter: the tree of the strongest conditional correlations.  The
   annotators' mark is one voter among them, with its own estimated accuracy.
3. *Classifier.*  A linear model over the found features is trained on the
   posterior labels and scores every whole text.

Learning uses a bounded sample (``sample_rows`` labelled rows in hash order;
of near copies, recognised by their least shingle hash, one stays).  Scoring
covers all rows.

Defined cases: null and empty texts have the score of a text without any
feature; without labelled rows every score comes from the insult list alone;
repeated rows each get their row; a label row that repeats a document counts
once with its highest mark.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import arrow_map, free_names, hash_share, materialise, slices, take_over

# Insults in common use, English, French, German, Spanish.
INSULTS = """
idiot idiots moron morons stupid dumb dumbass loser losers clown scum trash garbage pathetic worthless
disgusting ugly filthy vermin bastard bitch asshole whore slut retard retarded freak coward imbecile
connard salope idiote imbécile ordure minable pute crétin abruti
arschloch dummkopf trottel abschaum idiotisch wertlos erbärmlich schlampe hurensohn
imbécil estúpido estúpida basura escoria puta cabrón asqueroso inútil
""".split()

_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"(?:\b[A-Z]{3,}\b[\W_]*){4}")
_BANG = re.compile(r"!{3,}")
_YOU = re.compile(r"\b(?:you|tu|du|tú)\b", re.I)
#: word beginnings and endings that can become voters, by length
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7, 8), (4, 5)
CACHE_ENTRIES = 250_000


def word_features(word: str) -> list[str]:
    """Names of what a lower-case word can vote by."""
    n = len(word)
    return ([word] + [word[:k] + "*" for k in PREFIXES if n > k] + ["*" + word[-k:] for k in SUFFIXES if n > k])


def patterns(text: str, n_insults: int) -> list[int]:
    """Voters that need no word list: shouting, exclamations, an insult near
    a second person."""
    return [int(_SHOUT.search(text) is not None), int(_BANG.search(text) is not None),
            int(n_insults > 0 and _YOU.search(text) is not None)]


PATTERN_NAMES = ["shouting", "exclamations", "insult to you"]


@dataclass
class Model:
    """features[k] has weight[k]; then come log1p(hits), hits per word, the
    insult count, the patterns and the constant."""

    features: list[str]
    weight: np.ndarray
    voters: list[str] = field(default_factory=list)
    precision: list[float] = field(default_factory=list)


class Features:
    """Which features a text has.  White-space chunks are looked up whole."""

    def __init__(self, names: list[str]):
        self.at = {f: k for k, f in enumerate(names)}
        self.insults = set(INSULTS)
        self.n = len(names)
        self._clear()

    def _clear(self):
        self.chunks: dict[str, int] = {}
        self.sets: list[tuple[tuple[int, ...], int]] = [((), 0)]
        self.known_sets: dict[tuple, int] = {((), 0): 0}

    def _learn(self, chunk: str) -> int:
        words = _WORD.findall(chunk)
        key = (tuple(sorted({self.at[f] for w in words for f in word_features(w) if f in self.at})),
               sum(w in self.insults for w in words))
        k = self.known_sets.get(key)
        if k is None:
            k = self.known_sets[key] = len(self.sets)
            self.sets.append(key)
        self.chunks[chunk] = k
        return k

    def of(self, text: str | None) -> tuple[list[int], list[float]]:
        """Features that occur, and the dense values after them."""
        text = text or ""
        chunks = text.lower().split()
        if len(self.chunks) > CACHE_ENTRIES:
            self._clear()
        known = self.chunks
        for c in set(chunks):
            if c not in known:
                self._learn(c)
        codes = np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        counts = np.bincount(codes, minlength=1)
        hit = np.flatnonzero(counts[1:]) + 1
        found, insults, hits = set(), 0, 0
        for k in hit.tolist():
            names, bad = self.sets[k]
            found.update(names)
            hits += int(counts[k])
            insults += bad * int(counts[k])
        dense = [np.log1p(hits), hits / max(len(chunks), 1), np.log1p(insults), *patterns(text, insults), 1.0]
        return sorted(found), dense


DENSE = 4 + len(PATTERN_NAMES)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str,
                  label_col: str) -> DataFrame:
    """(_text, _y): at most ``sample_rows`` labelled rows in hash order,
    then without near copies (equal least hash of five-word shingles)."""
    marks = (labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
             .agg(F.max(label_col).alias("_y")))
    n = marks.count()
    # a share by hash first, so that few more than sample_rows rows meet in the limit
    marks = (marks.filter(hash_share(F.col("_id"), min(1.0, 1.5 * sample_rows / max(n, 1))))
             .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(
        F.broadcast(marks.select("_id", "_y")), "_id")          # at most sample_rows short rows
    words = F.split(F.lower(F.coalesce("_text", F.lit(""))), r"\s+")
    rows = rows.withColumn("_w", words)
    shingles = F.when(F.size("_w") >= 5, F.transform(
        F.sequence(F.lit(0), F.size("_w") - 5), lambda i: F.xxhash64(F.slice("_w", i + 1, 5)))
    ).otherwise(F.array(F.xxhash64("_w")))
    first = Window.partitionBy("_least").orderBy(F.desc("_y"), "_id", "_text")
    return (rows.withColumn("_least", F.array_min(shingles)).withColumn("_n", F.row_number().over(first))
            .filter("_n = 1").select("_id", "_text", F.col("_y").cast("int").alias("_y")))


def find_features(rows: DataFrame, limit: int, least_docs: int = 4, least_share: float = 0.4) -> list[str]:
    """The ``limit`` features with the strongest positive association with the
    mark, by the likelihood ratio of their document counts, of those with at
    least ``least_share`` of them in marked documents.  Counting runs in
    Spark; only the best rows come to the driver."""
    total = rows.groupBy("_y").count().collect()
    n1 = sum(r["count"] for r in total if r["_y"] > 0)
    n0 = sum(r["count"] for r in total if not r["_y"] > 0)
    if not n1 or not n0:
        return []
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("_text", F.lit(""))),
                                                  F.lit(r"(\p{L}+)"), F.lit(1)))
    # (document, word) pairs by mark; a beginning or ending adds up its words
    by_word = (rows.select("_y", F.explode(words).alias("w")).groupBy("w")
               .agg(F.sum(F.when(F.col("_y") > 0, 1).otherwise(0)).alias("t"), F.count("*").alias("n")))
    size = F.length("w")
    names = F.array_compact(F.array(
        F.col("w"), *[F.when(size > k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in PREFIXES],
        *[F.when(size > k, F.concat(F.lit("*"), F.substring(F.col("w"), -k, k))) for k in SUFFIXES]))
    counts = (by_word.select(F.explode(names).alias("f"), "t", "n").groupBy("f")
              .agg(F.sum("t").cast("double").alias("t"), F.sum("n").cast("double").alias("n")))
    pairs = by_word.agg(F.sum("t").alias("t"), F.sum("n").alias("n")).first()
    base = pairs["t"] / pairs["n"] if pairs["t"] else 0.0
    if not 0.0 < base < 1.0:
        return []
    share = F.col("t") / F.col("n")
    part = F.when(share < 1, (F.col("n") - F.col("t")) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    ratio = F.col("t") * F.log(share / base) + part
    best = (counts.filter((F.col("t") >= least_docs) & (share >= least_share))
            .withColumn("g", F.round(ratio, 9)).orderBy(F.desc("g"), "f").limit(limit))
    return [r["f"] for r in best.collect()]


def choose_voters(features: list[str], most: int) -> list[str]:
    """Best features first, without those that only lengthen or shorten a
    chosen one."""
    chosen: list[str] = []
    for f in features:
        core = f.strip("*")
        if not any(core.startswith(c.strip("*")) or c.strip("*").startswith(core) for c in chosen):
            chosen.append(f)
        if len(chosen) == most:
            break
    return chosen


@dataclass
class LabelModel:
    """P(label) and P(voter fires | label, its parent in the tree)."""

    prior: float
    parent: list[int]
    fires: np.ndarray            # [voter, label, parent fires]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, parent in enumerate(self.parent):
            given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), int)
            p1, p0 = self.fires[j, 1, given], self.fires[j, 0, given]
            odds += np.where(votes[:, j] > 0, np.log(p1 / p0), np.log((1 - p1) / (1 - p0)))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def precision(self, votes: np.ndarray) -> list[float]:
        """Estimated share of the label among the rows where a voter fires."""
        q = self.posterior(votes)
        return [float(q[v > 0].mean()) if v.any() else float("nan") for v in votes.T]


def _tree(votes: np.ndarray, q: np.ndarray) -> list[int]:
    """Maximum spanning tree of the mutual information of voter pairs given
    the label; parents come before their children's look-up by index only."""
    n, v = votes.shape
    x = votes.astype(float)
    mutual = np.zeros((v, v))
    for w in (q, 1 - q):
        total = w.sum() + 2.0
        both = (x.T @ (x * w[:, None]) + 0.5) / total
        one = (x.T @ w + 1.0) / total
        for a in (0, 1):
            for b in (0, 1):
                pa_, pb = (one if a else 1 - one), (one if b else 1 - one)
                pab = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both,
                       (0, 0): 1 - one[:, None] - one[None, :] + both}[a, b]
                pab = np.maximum(pab, 1e-9)
                mutual += total / (n + 4.0) * pab * np.log(pab / (pa_[:, None] * pb[None, :]))
    parent, best, link, todo = [-1] * v, np.full(v, -np.inf), [-1] * v, set(range(v))
    at = 0
    while todo:
        todo.discard(at)
        for j in todo:
            if mutual[at, j] > best[j]:
                best[j], link[j] = mutual[at, j], at
        if todo:
            at = max(sorted(todo), key=lambda j: best[j])
            parent[at] = link[at]
    return parent


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 12) -> LabelModel:
    """Expectation maximisation from a starting posterior."""
    q = start.astype(float)
    model = None
    for step in range(rounds):
        if step in (0, 4, 8):
            parent = _tree(votes, q)
        fires = np.zeros((votes.shape[1], 2, 2))
        for j, up in enumerate(parent):
            given = votes[:, up] if up >= 0 else np.zeros(len(votes), int)
            for y, w in ((1, q), (0, 1 - q)):
                for g in (0, 1):
                    on = w * (given == g)
                    rate = (w @ votes[:, j] + 0.5) / (w.sum() + 1.0)
                    fires[j, y, g] = (on @ votes[:, j] + 2.0 * rate) / (on.sum() + 2.0)
        model = LabelModel(float(np.clip(q.mean(), 1e-3, 1 - 1e-3)), parent, np.clip(fires, 1e-4, 1 - 1e-4))
        q = model.posterior(votes)
    return model


def fit_linear(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Logistic regression on soft labels (Newton steps, ridge penalty; the
    last column is the constant and is not penalised)."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (target - p) - penalty * w
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w += step * min(1.0, 5.0 / np.abs(step).max())
    return w


def fallback_model() -> Model:
    """Without labelled rows: any insult is a strong sign."""
    w = np.zeros(DENSE)
    w[2], w[-1] = 4.0, -3.0
    return Model([], w)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 15_000, features: int = 500,
          voters: int = 60, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    """Find voters, fit the label model and train the classifier."""
    rows = materialise(training_rows(docs, labels, sample_rows, id_col, text_col, label_col), "labelled")
    names = find_features(rows, features)
    if not names:
        return fallback_model()
    chosen = choose_voters(names, voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("toxicity", _SCORERS.clear)
        f = Features(names)
        for b in slices(batches, 1):
            got = [f.of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([g[0] for g in got], pa.list_(pa.int32())),
                 pa.array([list(map(float, g[1])) for g in got], pa.list_(pa.float64()))],
                ["id", "y", "found", "dense"])

    kind = rows.schema["_id"].dataType.simpleString()
    got = arrow_map(rows, run, f"id {kind}, y int, found array<int>, dense array<double>") \
        .orderBy("id").collect()                                    # at most sample_rows short rows
    x = np.zeros((len(got), len(names) + DENSE))
    for k, r in enumerate(got):
        x[k, r["found"]] = 1.0
        x[k, len(names):] = r["dense"]
    y = np.asarray([int(r["y"] > 0) for r in got])
    at = {f: k for k, f in enumerate(names)}
    votes = np.column_stack([x[:, [at[f] for f in chosen]] > 0, x[:, len(names) + 2] > 0,
                             x[:, len(names) + 3:len(names) + 3 + len(PATTERN_NAMES)] > 0, y > 0]).astype(int)
    label_model = fit_label_model(votes, np.where(y > 0, 0.95, 0.05))
    target = label_model.posterior(votes)
    return Model(names, fit_linear(x, target),
                 [*chosen, "insult list", *PATTERN_NAMES, "annotators"], label_model.precision(votes))


_SCORERS: dict[str, Features] = {}


def _features(name: str, model: Model) -> Features:
    """The features of a model, kept over the tasks of a worker."""
    take_over("toxicity", _SCORERS.clear)
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Features(model.features)
    return _SCORERS[name]


def mark_rows(docs: DataFrame, model: Model, text_col: str, score_name: str) -> DataFrame:
    """All columns of the rows with the score of the whole text beside them."""
    names, at = docs.columns, docs.columns.index(text_col)
    name, n = uuid.uuid4().hex, len(model.features)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, w = _features(name, model), model.weight
        for b in slices(batches, at):
            z = []
            for t in b.column(at).to_pylist():
                found, dense = f.of(t)
                z.append(w[found].sum() + w[n:] @ np.asarray(dense))
            p = 1 / (1 + np.exp(-np.clip(np.asarray(z, float), -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*names, score_name])

    return arrow_map(docs, run, ", ".join([*fields, f"`{score_name}` double"]))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted) of every whole text."""
    marked = mark_rows(docs.select(id_col, F.col(text_col).cast("string").alias(text_col)), model, text_col, "score")
    return marked.select(id_col, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_rows(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Rows, with all their columns, that score below the threshold."""
    (name,) = free_names(docs.columns, "_toxicity")
    return mark_rows(docs, model, text_col, name).filter(F.col(name) < threshold).drop(name)
