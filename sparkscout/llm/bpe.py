"""Byte-level BPE encoding and decoding (operator 10).

Merging a pre-token works on a linked list of its byte spans.  A
:class:`RankQueue` holds, for every merge rank, the positions whose span and
next span form that merge; a two-level bitmap over the ranks gives the
lowest non-empty rank by find-first-set, so each step costs the same however
long the pre-token is.  Entries whose span has changed meanwhile are skipped
when they come up.

Defined cases: a null or empty text has no ids; a pre-token that is itself in
the vocabulary is one id; equal pairs merge leftmost first.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, take_over
from .tokenizing import ARROW_CHARS, ARROW_TEXTS, SeenTwice, cut_words, grouped, irregular, put_together


#: single bits of a word of the bitmap
_BIT = [1 << k for k in range(256)]


class RankQueue:
    """Positions in buckets by merge rank, below a bitmap of two levels (256
    ranks a word, words in one top word)."""

    __slots__ = ("buckets", "words", "top")

    def __init__(self):
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, pos: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, pos)
            return
        self.buckets[rank] = [pos]
        w = rank >> 8
        self.words[w] = self.words.get(w, 0) | _BIT[rank & 255]
        self.top |= 1 << w

    def pop(self) -> tuple[int, int] | None:
        """Lowest rank and its leftmost position, or None."""
        top = self.top
        if not top:
            return None
        w = (top & -top).bit_length() - 1
        word = self.words[w]
        rank = (w << 8) + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        pos = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.words[w] = word = word & (word - 1)
            if not word:
                self.top = top & (top - 1)
        return rank, pos


def short_ranks(ranks: dict[bytes, int]) -> tuple[list[int], list[int | None]]:
    """Ranks of all single bytes, and of all pairs of bytes (None: no merge)."""
    ones = [bytes([b]) for b in range(256)]
    return [ranks.get(a) for a in ones], [ranks.get(a + b) for a in ones for b in ones]


def merge_piece(piece: bytes, ranks: dict[bytes, int], singles: list[int], pairs: list[int | None]) -> list[int]:
    """ids of one pre-token, with the ranks of :func:`short_ranks` at hand.
    (The queue's steps are written out here: a call for each costs more than
    the step.)"""
    find = ranks.get
    whole = find(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    ids = [singles[b] for b in piece]
    end = list(range(1, n + 1))            # span of node i is piece[i:end[i]]; node end[i] follows
    before = list(range(-1, n))            # node that precedes i
    current: list[int | None] = [None] * n  # rank of node i with its successor
    queue = RankQueue()
    buckets, words, top, bit = queue.buckets, queue.words, 0, _BIT
    for i in range(n - 1):
        r = pairs[piece[i] << 8 | piece[i + 1]]
        if r is not None:
            current[i] = r
            if r in buckets:
                buckets[r].append(i)       # positions grow, so the list is a heap
            else:
                buckets[r] = [i]
                w = r >> 8
                words[w] = words.get(w, 0) | bit[r & 255]
                top |= 1 << w
    while top:
        w = (top & -top).bit_length() - 1
        word = words[w]
        r = (w << 8) + (word & -word).bit_length() - 1
        bucket = buckets[r]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[r]
            words[w] = word = word & (word - 1)
            if not word:
                top &= top - 1
        if current[i] != r:                # stale: absorbed, or its span has grown
            continue
        j = end[i]
        stop = end[i] = end[j]
        ids[i], current[j] = r, None
        if stop < n:
            before[stop] = i
            new = current[i] = find(piece[i:end[stop]])
            if new is not None:
                if new in buckets:
                    heappush(buckets[new], i)
                else:
                    buckets[new] = [i]
                    w = new >> 8
                    words[w] = words.get(w, 0) | bit[new & 255]
                    top |= 1 << w
        else:
            current[i] = None
        if i:
            h = before[i]
            new = find(piece[h:stop])
            if new != current[h]:
                current[h] = new
                if new is not None:
                    if new in buckets:
                        heappush(buckets[new], h)
                    else:
                        buckets[new] = [h]
                        w = new >> 8
                        words[w] = words.get(w, 0) | bit[new & 255]
                        top |= 1 << w
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = end[i]
    return out


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.short = short_ranks(self.ranks)
        self.split = regex.compile(pattern).findall
        self.pieces = SeenTwice(900_000, twice=False)
        self.chunks = SeenTwice()

    def _learn_pieces(self, pieces: set[str]) -> list[str]:
        new = self.pieces.missing(pieces)
        for p in new:
            self.pieces.known[p] = _pack(merge_piece(p.encode(), self.ranks, *self.short))
        return new

    def encode_group(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers.  A text
        of single spaces and line feeds only is cut at them, which the pattern
        never crosses; any other text is cut by the pattern as a whole."""
        heads, lines = [], []
        for t in texts:
            first, _, rest = (t, "", "") if not t or irregular(t) else t.replace("\n", " \n").partition(" ")
            heads.append(self.split(first))
            lines.append(rest or None)
        ends, places, keys = cut_words(lines)
        known = self.chunks.known
        missing = [k for k in keys if k not in known]
        cut = [self.split(p if p[:1] == "\n" else " " + p) for p in missing]
        new = self._learn_pieces(set().union(*cut, *heads))
        piece = self.pieces.known.__getitem__
        for p, own in zip(missing, cut):
            known[p] = piece(own[0]) if len(own) == 1 else b"".join(map(piece, own))
        out = [b"".join(map(piece, h)) + d for h, d in zip(heads, put_together(known, ends, places, keys))]
        self.pieces.settle(new)
        self.chunks.settle(missing)
        return out

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """ids of each text in turn."""
        for group in grouped(texts, ARROW_TEXTS, ARROW_CHARS):
            yield from self.encode_group(group)

    def encode(self, text: str | None) -> bytes:
        return self.encode_group([text or ""])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    key = (path, pattern)
    take_over("bpe", _CODECS.clear)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(path, pattern)
    return _CODECS[key]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            ids = [np.frombuffer(x, "<i4") for x in c.encode_many(b.column(1).to_pylist())]
            offsets = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], [id_col, "ids"])

    return arrow_map(docs.select(id_col, F.col(text_col).cast("string")), run,
                     f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
               ids_col: str = "ids") -> DataFrame:
    """(id_col, data binary): the bytes of each row's ids (null: none)."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        tokens = codec(ranks_path, pattern).tokens
        for b in batches:
            data = [b"".join(map(tokens.__getitem__, x or ())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())],
                                             [id_col, "data"])

    return arrow_map(encoded.select(id_col, ids_col), run, f"`{id_col}` {kind}, data binary")


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of every whole text,
    encoded and decoded in one pass without shipping the ids between tasks."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(ranks_path, pattern)
        for b in batches:
            n, enc, dec = [], [], []
            for ids in c.encode_many(b.column(1).to_pylist()):
                n.append(len(ids) // 4)
                enc.append(hashlib.sha256(ids).hexdigest())
                dec.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(enc, pa.string()),
                 pa.array(dec, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(id_col, F.col(text_col).cast("string")), run,
                     f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
