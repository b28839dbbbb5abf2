"""Alignment of the tokens of two tokenizers (operator 13).

Both sides are token lists over the same bytes (a space and the text), side A
of a byte-level file, side B of a sentencepiece model.  ``pandas.merge_asof``,
keyed by document, finds for each token start the other side's token that
covers it; the union of both directions is every pair of tokens whose byte
ranges overlap.  Offsets where tokens of both sides end cut them into groups.

A long text is cut into parts of about ``PART`` characters before a space
between two words.  No token of either side reaches over such a place, so the
parts are aligned one by one and put together again; a task holds one group of
parts at a time.

The counts of linked id pairs come from the stored pairs of all documents, one
row per document and pair.  They are looked up by a join: as a broadcast if the
table of counts has at most ``BROADCAST_PAIRS`` rows, else by shuffle, with the
same result.

Defined cases: null and empty texts, and texts whose tokens do not spell out
the same bytes (a literal U+2581, for one), have no tokens: zeros and an empty
digest; strings of special tokens are plain text; pairs of equal count are all
the best of their B id; repeated rows count each; an empty table gives no rows;
other columns are ignored.  A stretch of a long text without a space between
two words is encoded in one piece.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, materialise, take_over
from .tokenizing import SeenTwice, cut_words, encoder, irregular, put_together

#: characters after which a long text may be cut, of a group of parts, and of parts that are encoded together
PART, GROUP_CHARS, ENCODE_CHARS = 500_000, 500_000, 2_000_000
#: the count table is broadcast up to this many rows (about 20 bytes each)
BROADCAST_PAIRS = 2_000_000

_CUT = re.compile(r"(?<=\S) (?=\S)")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text cut at spaces between words, those spaces left out."""
    at = 0
    while at <= len(text):
        gap = _CUT.search(text, at + size) if at + size < len(text) else None
        yield text[at:gap.start()] if gap else text[at:]
        at = gap.end() if gap else len(text) + 1


def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level file."""
    from tokenizers import Tokenizer
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]     # bytes that stand for themselves
    other = [b for b in range(256) if b not in plain]
    code = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}
    vocab = Tokenizer.from_file(path).get_vocab()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
    return out


def piece_bytes(model) -> list[bytes]:
    """The bytes of every id of a sentencepiece model."""
    return [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i)
            else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]


class Side:
    """Bytes and byte lengths of one side's ids."""

    def __init__(self, table: list[bytes]):
        self.size = len(table)
        self.length = np.asarray([len(b) for b in table], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens one after another."""
        size = self.length[ids]
        ends = np.cumsum(size)
        shift = self.first[ids] - (ends - size)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(shift, size)]

    def spells(self, ids: list[np.ndarray], data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the tokens of each part are the bytes of ``data`` up to its end."""
        sizes = np.diff(ends, prepend=0)
        own = np.asarray([int(self.length[i].sum()) for i in ids])
        same = own == sizes
        if same.all():
            off = np.flatnonzero(self.spelled(np.concatenate(ids)) != data)
            same[np.searchsorted(ends, off, "right")] = False
        else:
            for k in np.flatnonzero(same):
                same[k] = np.array_equal(self.spelled(ids[k]), data[ends[k] - sizes[k]:ends[k]])
        return same


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Pieces:
    """ids of a sentencepiece model.  No piece reaches from a letter over a
    space, so a text whose white space is single spaces and line feeds is
    looked up word by word; words not seen before are encoded together."""

    def __init__(self, model):
        self.model, self.known = model, SeenTwice()

    def _learn(self, words: list[str]) -> None:
        for w, ids in zip(words, self.model.encode(words, num_threads=1)):
            # a line feed stays apart from the space that the model puts before it
            self.known.known[w] = _pack(ids[1:] if w[:1] == "\n" else ids)

    def whole(self, text: str) -> bytes:
        return _pack(self.model.encode(text))

    def words(self, ends: np.ndarray, places: pa.Array, keys: list[str]) -> list[bytes]:
        """ids of each line of words that ``cut_words`` found."""
        known = self.known.known
        missing = [k for k in keys if k not in known]
        if missing:
            self._learn(missing)
        out = put_together(known, ends, places, keys)
        if missing:
            self.known.settle(missing)
        return out


class Aligner:
    """Encodes texts on both sides and aligns the tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        self.enc = encoder(path_a, True, plain_special=True)
        model = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.pieces = Pieces(model)
        self.a, self.b = Side(byte_level_bytes(path_a)), Side(piece_bytes(model))
        self.text = pa.array([f"{i}{mark}" for i in range(max(self.a.size, self.b.size)) for mark in ",|;"],
                             pa.large_binary())

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """ids of both sides of each part.  Both cut the same texts into the
        same words, which is done once."""
        odd = [not t or irregular(t) for t in texts]
        words = cut_words([None if o else t.replace("\n", " \n") for o, t in zip(odd, texts)])
        left = [self.enc.whole(" " + t) if o else d for o, t, d in zip(odd, texts, self.enc.words(*words))]
        right = [self.pieces.whole(t) if o else d for o, t, d in zip(odd, texts, self.pieces.words(*words))]
        return left, right

    def spelled(self, texts: list[str], left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """Whether both sides spell out each part."""
        parts = [(" " + t).encode() for t in texts]
        data, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
        return self.a.spells(left, data, ends) & self.b.spells(right, data, ends)


def overlaps(start_a: np.ndarray, start_b: np.ndarray, key_a: np.ndarray,
             key_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all pairs of tokens that overlap.  Starts grow
    over all tokens; a pair that starts together is found from both sides."""
    a = pd.DataFrame({"start": start_a, "doc": key_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"start": start_b, "doc": key_b, "b": np.arange(len(start_b))})
    forth = pd.merge_asof(a, b, on="start", by="doc")                     # B token that covers A's start
    back = pd.merge_asof(b, a, on="start", by="doc")                      # A token that covers B's start
    back = back[start_a[back["a"].to_numpy()] != start_b]
    return (np.concatenate([forth["a"].to_numpy(), back["a"].to_numpy()]),
            np.concatenate([forth["b"].to_numpy(), back["b"].to_numpy()]))


def align(al: Aligner, texts: list[str]) -> list[tuple | None]:
    """Per part: None if a side does not spell it out, else (n_a, n_b,
    n_groups, n_links, groups as bytes ending with a semicolon, pair codes,
    times of each).  The parts are encoded together and aligned in groups."""
    left, right = al.encode(texts)
    out, lo, chars = [], 0, 0
    for hi, t in enumerate(texts, 1):
        chars += len(t)
        if chars >= GROUP_CHARS or hi == len(texts):
            out += _align(al, texts[lo:hi], left[lo:hi], right[lo:hi])
            lo, chars = hi, 0
    return out


def _align(al: Aligner, texts: list[str], left: list[bytes], right: list[bytes]) -> list[tuple | None]:
    """The same of one group, encoded."""
    left, right = ([np.frombuffer(d, "<u4").astype(np.int64) for d in side] for side in (left, right))
    good = np.flatnonzero(al.spelled(texts, left, right)).tolist()
    out: list = [None] * len(texts)
    if not good:
        return out
    n_a, n_b = (np.asarray([len(side[k]) for k in good]) for side in (left, right))
    ids_a, ids_b = (np.concatenate([side[k] for k in good]) for side in (left, right))
    key_a, key_b = np.repeat(np.arange(len(good)), n_a), np.repeat(np.arange(len(good)), n_b)
    end_a, end_b = np.cumsum(al.a.length[ids_a]), np.cumsum(al.b.length[ids_b])
    a, b = overlaps(end_a - al.a.length[ids_a], end_b - al.b.length[ids_b], key_a, key_b)
    # groups: up to the next offset where both sides end
    ends = end_a[end_b[np.searchsorted(end_b, end_a)] == end_a]
    group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
    of_a, of_b = np.bincount(group_a), np.bincount(group_b)
    place = np.empty(len(ids_a) + len(ids_b), np.int64)
    place[np.arange(len(ids_a)) + (np.cumsum(of_b) - of_b)[group_a]] = 3 * ids_a + last_a
    place[np.arange(len(ids_b)) + np.cumsum(of_a)[group_b]] = 3 * ids_b + 2 * last_b
    _, at, data = al.text.take(pa.array(place)).buffers()
    data = memoryview(data)
    # pairs of each part, equal ones counted
    size_b = al.b.size
    codes = ids_a[a] * size_b + ids_b[b]
    room = al.a.size * size_b
    code, times = np.unique(key_a[a] * room + codes, return_counts=True)
    owner = code // room
    cut = np.searchsorted(owner, np.arange(len(good) + 1))
    to = np.frombuffer(at, np.int64)[np.append(0, np.cumsum(n_a + n_b))].tolist()
    groups = np.bincount(key_a[last_a], minlength=len(good))
    links = np.bincount(key_a[a], minlength=len(good))
    for g, k in enumerate(good):
        out[k] = (int(n_a[g]), int(n_b[g]), int(groups[g]), int(links[g]), bytes(data[to[g]:to[g + 1]]),
                  code[cut[g]:cut[g + 1]] - g * room, times[cut[g]:cut[g + 1]])
    return out


class _Document:
    """What the parts of one document add up to."""

    def __init__(self):
        self.sums, self.sha, self.tail, self.codes, self.times, self.good = np.zeros(4, np.int64), hashlib.sha256(), b"", [], [], True

    def add(self, part: tuple | None) -> None:
        if part is None:
            self.good = False
            return
        self.sums += part[:4]
        text = self.tail + part[4]
        self.sha.update(text[:-1])                   # the last mark goes unless more follows
        self.tail = text[-1:]
        self.codes.append(part[5]), self.times.append(part[6])

    def result(self) -> tuple:
        if not self.good or not self.codes:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        code, times = self.codes[0], self.times[0]
        if len(self.codes) > 1:
            code, at = np.unique(np.concatenate(self.codes), return_inverse=True)
            times = np.bincount(at, weights=np.concatenate(self.times)).astype(np.int64)
        return *self.sums.tolist(), self.sha.hexdigest(), code, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The process-wide aligner of two files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    take_over("alignment", _ALIGNERS.clear)
    return _ALIGNERS[path_a, path_b]


def token_alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """(row, id_col, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times):
    the alignment of each text; a pair code is the A id times the number of B
    ids plus the B id.  ``row`` numbers the rows."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        row = TaskContext.get().partitionId() << 33

        def results(texts: pa.Array) -> Iterator[tuple]:
            """One result a text; parts of several texts are aligned together."""
            group, owners, chars, open_docs = [], [], 0, []

            def flush():
                for d, p in zip(owners, align(al, group)):
                    d.add(p)
                group.clear(), owners.clear()

            for t in texts:
                doc = _Document()
                open_docs.append(doc)
                for part in parts(t.as_py()) if t.as_py() else ():
                    group.append(part), owners.append(doc)
                    chars += len(part)
                    if chars >= ENCODE_CHARS:
                        flush()
                        chars = 0
                if not group:
                    yield from (d.result() for d in open_docs)
                    open_docs = []
            if group:
                flush()
            yield from (d.result() for d in open_docs)

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                some = b.slice(at, 1000)
                got = list(results(some.column(1)))
                lists = [pa.ListArray.from_arrays(
                    pa.array(np.append(0, np.cumsum([len(g[c]) for g in got])), pa.int32()),
                    pa.array(np.concatenate([g[c] for g in got]), t)) for c, t in ((5, pa.int64()), (6, pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + len(got)), pa.int64()), some.column(0),
                     *(pa.array([g[c] for g in got], pa.int64()) for c in range(4)),
                     pa.array([g[4] for g in got], pa.string()), *lists],
                    ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                row += len(got)

    found = arrow_map(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")), run,
                      f"row bigint, id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                      "groups_sha256 string, pairs array<bigint>, times array<int>")
    return found.withColumnRenamed("id", id_col)


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): links of each id pair in the corpus, and whether
    no pair of its B id has more."""
    counts = materialise(found.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
                         .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count")), "counts")
    most = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("count").alias("most"))
    return counts.join(most, F.col("pair") % size_b == F.col("b")).select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def cross_alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256) of every document."""
    import sentencepiece
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    found = materialise(token_alignments(docs, path_a, path_b, id_col, text_col), "aligned")
    counts = materialise(pair_counts(found, size_b), "pairs")
    known = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
        "row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    sums = links.join(known, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    return found.drop("pairs", "times").join(sums, "row", "left").select(
        id_col, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
