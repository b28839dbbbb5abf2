"""Language identification with segmentation-marginalised unigrams
(operator 4).

Each language has a probability for every piece of a fixed public vocabulary.
A word's likelihood is the sum over all its segmentations into pieces, which a
forward pass over its characters gives; a text's is the product over its
letter runs.  The piece probabilities are fitted by expectation maximisation
(forward-backward counts), the vocabulary itself is never changed.

Learning uses a bounded sample of the labelled rows it is given
(``docs_per_lang`` whole texts a language, in hash order of the id).  Only
tables of vocabulary size come to the driver.

Defined cases: null text, and text without a letter, is ``und`` with score 0;
equally likely languages resolve to the first by name; without labelled rows
every text is ``und``; repeated rows each get their row.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import arrow_map, free_names, hash_share, materialise, slices, take_over

#: runs of letters (a superset of marks and numbers is cut off by isalpha)
_LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
_TAIL = ".,;:!?*#%&$|"
#: longest words that the table form of the forward pass takes
_TABLE = 48
#: words of one forward pass
_WORDS = 4_000
#: characters with a class of their own in the table of steps; the class of other characters of pieces
_CLASSES, _RARE = 95, 255
#: chunks of one process-wide cache
CACHE_ENTRIES = 450_000


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece model that can be part of a lower-case word."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size())
              if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return [p for p in pieces if p == MARK or (p.lstrip(MARK).isalpha() and p == p.lower()
                                              and not p.startswith(MARK * 2))]


class Lattice:
    """Piece look-up and the forward and backward passes over batches of
    words.  Piece 0 stands for any character that is no piece of its own."""

    def __init__(self, pieces: list[str]):
        self.ids = {p: k for k, p in enumerate(pieces, 1)}
        # beginnings of pieces that are no pieces: -1; anything else can't grow into one
        self.reach = {p[:k]: -1 for p in pieces for k in range(1, len(p))} | self.ids
        self.size = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        self._grow(pieces)

    def _grow(self, pieces: list[str]) -> None:
        """The beginnings of pieces as numbered states with a table of steps:
        ``step[state, class of the next character]``, 0 where no piece goes on
        so.  The commonest characters have a class each."""
        often = Counter(ch for p in pieces for ch in p)
        common = [ch for ch, _ in often.most_common(_CLASSES)]
        self.classes = np.zeros(sys.maxunicode + 1, np.uint8)      # 0: in no piece
        self.classes[[ord(ch) for ch in often]] = _RARE
        self.classes[[ord(ch) for ch in common]] = np.arange(1, len(common) + 1)
        place = {ch: k for k, ch in enumerate(common, 1)}
        state = {"": 1} | {b: k for k, b in enumerate(self.reach, 2)}
        self.step = np.zeros((len(state) + 1, len(common) + 1), np.uint16 if len(state) < 1 << 16 else np.int32)
        self.piece = np.zeros(len(state) + 1, np.int32)
        for b, k in state.items():
            if b and b[-1] in place:
                self.step[state[b[:-1]], place[b[-1]]] = k
            self.piece[k] = max(self.reach.get(b, 0), 0)

    def table(self, words: list[str]):
        """Every piece inside many marked words as (end, start, word rows,
        pieces), by ends, so that a forward pass can take them in order."""
        size = np.asarray([len(w) for w in words], np.int64)
        cls = self.classes[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
        row, first = np.repeat(np.arange(len(words)), size), np.cumsum(size) - size
        start = np.arange(len(cls)) - first[row]
        left = size[row] - start
        rare = np.zeros(len(words), bool)
        rare[row[cls == _RARE]] = True
        at = np.flatnonzero(~rare[row])
        state, found = np.ones(len(at), self.step.dtype), []
        for k in range(1, self.longest + 1):                       # all places a character further
            state = self.step[state, cls[at + k - 1]]
            piece = self.piece[state]
            hit = slice(None) if k == 1 else piece > 0
            found.append((start[at[hit]] + k, start[at[hit]], row[at[hit]], piece[hit]))
            on = (state > 0) & (left[at] > k)
            at, state = at[on], state[on]
            if not len(at):
                break
        found += [self._lookup(r, words[r]) for r in np.flatnonzero(rare).tolist()]
        end, start, row, piece = (np.concatenate(c) for c in zip(*found))
        width = int(size.max(initial=0)) + 1
        key = (end * width + start).astype(np.uint16 if width <= 256 else np.int64)
        order = np.lexsort((row, key)) if rare.any() else np.argsort(key, kind="stable")
        key, row, piece = key[order], row[order], piece[order]
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        return [(int(key[lo]) // width, int(key[lo]) % width, row[lo:hi], piece[lo:hi])
                for lo, hi in zip(cuts, cuts[1:]) if hi > lo]

    def _lookup(self, row: int, word: str) -> tuple[list, list, list, list]:
        """The same of one word, whatever its characters."""
        out, find, n = ([], [], [], []), self.reach.get, len(word)
        for s in range(n):
            for e in range(s + 1, min(n, s + self.longest) + 1):
                k = find(word[s:e])
                if e > s + 1 and k is None:
                    break
                if e == s + 1 or k > 0:
                    for column, value in zip(out, (e, s, row, max(k or 0, 0))):
                        column.append(value)
        return out

    def forward(self, words: list[str], p: np.ndarray, groups=None) -> np.ndarray:
        """alpha[word, position, language]; words of at most _TABLE marks."""
        n = max(map(len, words))
        alpha = np.zeros((len(words), n + 1, p.shape[1]))
        alpha[:, 0] = 1.0
        for e, s, rows, ids in groups if groups is not None else self.table(words):
            alpha[rows, e] += alpha[rows, s] * p[ids]
        return alpha

    def log_likelihood(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log P(word) by language, for words of any length."""
        out = np.zeros((len(words), p.shape[1]))
        short = [k for k, w in enumerate(words) if len(w) <= _TABLE]
        for at in range(0, len(short), _WORDS):
            part = short[at:at + _WORDS]
            batch = [words[k] for k in part]
            alpha = self.forward(batch, p)
            out[part] = np.log(alpha[np.arange(len(batch)), [len(w) for w in batch]])
        for k, w in enumerate(words):
            if len(w) > _TABLE:
                out[k] = self._long(w, p)
        return out

    def _long(self, word: str, p: np.ndarray) -> np.ndarray:
        """Forward pass that keeps the last columns only and rescales them."""
        width = self.longest + 1
        ring = np.zeros((width, p.shape[1]))
        ring[0] = 1.0
        scale, find = np.zeros(p.shape[1]), self.ids.get
        for e in range(1, len(word) + 1):
            col = ring[(e - 1) % width] * p[find(word[e - 1], 0)]
            for s in range(max(0, e - self.longest), e - 1):
                k = find(word[s:e])
                if k is not None:
                    col = col + ring[s % width] * p[k]
            ring[e % width] = col
            if e % 8 == 0:
                top = ring.max(axis=0)
                ring /= top
                scale += np.log(top)
        return np.log(ring[len(word) % width]) + scale

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts by language, for counts[word, language]."""
        groups = self.table(words)
        alpha = self.forward(words, p, groups)
        last = np.asarray([len(w) for w in words])
        total = alpha[np.arange(len(words)), last]
        beta = np.zeros_like(alpha)
        beta[np.arange(len(words)), last] = counts / total
        out = np.zeros_like(p)
        for e, s, rows, ids in sorted(groups, key=lambda g: (-g[1], -g[0])):
            flow = p[ids] * beta[rows, e]
            beta[rows, s] += flow
            flow = flow * alpha[rows, s]
            for lang in range(p.shape[1]):
                out[:, lang] += np.bincount(ids, flow[:, lang], self.size)
        return out


@dataclass
class Model:
    """Learned languages (sorted) and p[piece, language]."""

    vocabulary_path: str
    langs: list[str]
    p: np.ndarray


def learn(docs: DataFrame, vocabulary_path: str, docs_per_lang: int = 500, rounds: int = 3,
          prior: float = 0.1, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Model:
    """Fit from the rows with text and language.  ``prior`` is the count that
    every piece has before it is seen."""
    named = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    keys = named.select(F.col(lang_col).cast("string").alias("_lang"), F.col(id_col).alias("_id"))
    sizes = {r["_lang"]: r["count"] for r in keys.groupBy("_lang").count().collect()}   # a row a language
    share = F.lit(1.0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("_lang") == lang, min(1.0, 2.0 * docs_per_lang / n)).otherwise(share)
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_id"), "_id")
    # a share by hash first, so that few more rows than the bound meet in a window
    ids = (keys.filter(hash_share(F.col("_id"), share) | (F.col("_id").isNull()))
           .withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= docs_per_lang)
           .select("_id").distinct())
    # at most docs_per_lang ids a language go to the tasks; the texts stay where they are
    sample = named.join(F.broadcast(ids), named[id_col].eqNullSafe(ids["_id"]), "left_semi")
    runs = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(\p{L}+)"), F.lit(1)))
    words = materialise(sample.select(F.col(lang_col).alias("lang"), runs.alias("word"))
                        .filter(F.length("word") < _TABLE)
                        .groupBy("word", "lang").agg(F.count("*").alias("n")), "words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    lattice = Lattice(vocabulary(vocabulary_path))
    p = np.full((lattice.size, max(len(langs), 1)), 1.0 / lattice.size)
    place = {x: k for k, x in enumerate(langs)}
    for _ in range(rounds if langs else 0):
        counts = _expected_counts(words, vocabulary_path, place, p) + prior
        p = counts / counts.sum(axis=0)
    return Model(vocabulary_path, langs, p)


def _expected_counts(words: DataFrame, path: str, place: dict[str, int], p: np.ndarray) -> np.ndarray:
    """Sum over the word table of the expected piece counts; every task sends
    one table of vocabulary size, added up in a fixed order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("langid", _SCORERS.clear)
        lattice, total = lattice_of(path), np.zeros_like(p)
        for b in batches:
            word, lang, n = (c.to_pylist() for c in b.columns)
            index = {w: k for k, w in enumerate(dict.fromkeys(word))}
            counts = np.zeros((len(index), p.shape[1]))
            for w, x, c in zip(word, lang, n):
                counts[index[w], place[x]] += c
            if index:
                total += lattice.expected([MARK + w for w in index], counts, p)
        keep = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keep), pa.array(total.reshape(-1)[keep])], ["at", "n"])

    sums = arrow_map(words, run, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(p.size)
    for b in sums.toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return out.reshape(p.shape)


_LATTICES: dict[str, Lattice] = {}


def lattice_of(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(vocabulary(path))
    return _LATTICES[path]


class Scorer:
    """Log-likelihoods of texts.  What stands between white space is looked up
    as a whole; its letter runs are scored once and kept."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, lattice_of(model.vocabulary_path)
        self._clear()

    def _clear(self):
        self.chunks: dict[str, int] = {}
        self.runs: dict[str, int] = {}
        # per row: log-likelihood by language, then the number of letters; row 0: no letter
        self.values, self.used = np.zeros((1 << 14, len(self.model.langs) + 1)), 1

    def _add(self, rows: np.ndarray) -> int:
        first, self.used = self.used, self.used + len(rows)
        if self.used > len(self.values):
            more = np.zeros((max(len(self.values), len(rows)), rows.shape[1]))
            self.values = np.concatenate([self.values, more])
        self.values[first:self.used] = rows
        return first

    def learn(self, chunks: list[str]) -> None:
        parts, runs = {}, self.runs
        for c in chunks:
            own = c.rstrip(_TAIL)
            if own.isalpha():
                parts[c] = (own,)
            else:
                parts[c] = tuple(x for r in _LETTERS.findall(c)
                                 if (x := r if r.isalpha() else "".join(filter(str.isalpha, r))))
        new = [r for r in dict.fromkeys(r for rs in parts.values() for r in rs) if r not in runs]
        if new:
            like = self.lattice.log_likelihood([MARK + r for r in new], self.model.p)
            first = self._add(np.column_stack([like, [len(r) for r in new]]))
            runs.update(zip(new, range(first, first + len(new))))
        for c, rs in parts.items():
            self.chunks[c] = (runs[rs[0]] if len(rs) == 1 else 0 if not rs else
                              self._add(self.values[[runs[r] for r in rs]].sum(axis=0, keepdims=True)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """One row per text: log-likelihood by language, number of letters."""
        out = np.zeros((len(texts), self.values.shape[1]))
        for at in range(0, len(texts), 500):
            split = [(t or "").lower().split() for t in texts[at:at + 500]]
            known = self.chunks
            new = list(dict.fromkeys(c for cs in split for c in cs if c not in known))
            if len(known) + len(new) > CACHE_ENTRIES:
                self._clear()
                new = list(dict.fromkeys(c for cs in split for c in cs))
            if new:
                self.learn(new)
            for k, cs in enumerate(split, at):
                if cs:
                    rows = np.fromiter(map(self.chunks.__getitem__, cs), np.int64, len(cs))
                    out[k] = self.values[rows].sum(axis=0)
        return out


_SCORERS: dict[str, Scorer] = {}


def _scorer(name: str, model: Model) -> Scorer:
    """The scorer of a model, kept over the tasks of a worker."""
    take_over("langid", _SCORERS.clear)
    if name not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[name] = Scorer(model)
    return _SCORERS[name]


def decide(scorer: Scorer, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior under equal priors."""
    langs = scorer.model.langs
    s = scorer.score(texts)
    known = (s[:, -1] > 0) & bool(langs)
    like = s[:, :-1] if langs else np.zeros((len(texts), 1))
    best = like.argmax(axis=1)
    post = 1.0 / np.exp(like - like.max(axis=1, keepdims=True)).sum(axis=1)
    return [langs[k] if ok else "und" for k, ok in zip(best, known)], np.where(known, post, 0.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) of every whole text.  The model that goes to
    the tasks is of vocabulary size."""
    return mark_rows(docs.select(id_col, F.col(text_col).cast("string").alias(text_col)), model, text_col,
                     "lang_pred", "score").select(id_col, "lang_pred", "score")


def filter_rows(docs: DataFrame, model: Model, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows, with all their columns, whose text is in a learned language with
    at least this score."""
    lang, score = free_names(docs.columns, "_lang_pred", "_lang_score")
    return mark_rows(docs, model, text_col, lang, score).filter(
        (F.col(lang) != "und") & (F.col(score) >= least_score)).drop(lang, score)


def mark_rows(docs: DataFrame, model: Model, text_col: str, lang_name: str, score_name: str) -> DataFrame:
    """All columns of the rows with prediction and score beside them."""
    names, at = docs.columns, docs.columns.index(text_col)
    name, fields = uuid.uuid4().hex, [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(name, model)
        for b in slices(batches, at):
            lang, score = decide(scorer, b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lang, pa.string()), pa.array(score)],
                [*names, lang_name, score_name])

    return arrow_map(docs, run, ", ".join([*fields, f"`{lang_name}` string", f"`{score_name}` double"]))
