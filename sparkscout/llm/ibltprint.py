"""Document fingerprints as invertible Bloom lookup sketches (operator 11).

A text is cut into paragraphs: its lines, cut again after sentence ends and,
where a stretch is still long, after words chosen by their hash.  Every
paragraph gets a 64-bit digest, mixed with the number of equal paragraphs
before it, so repeats count.  A sketch has cells in three tables; a digest adds
one to the count, itself to the key sum and its check hash to the check sum of
one cell of each table.  The fingerprint is the sketch of ``CELLS`` cells.

Two versions are compared by subtracting their sketches: common paragraphs
cancel.  Cells that hold a single digest are peeled, round after round, for
all pairs of a batch at once, until every cell is empty; what was peeled are
the differing digests.  Pairs that stay stuck are retried with a larger sketch
of both sides.  Likeness is the share of paragraphs that did not differ.

The next document in the order of ids is the next row of a range-sorted
partition; only the first and last row of each partition meet their
neighbours in a second, small step.

Defined cases: a null text is an empty one; two texts without paragraphs have
likeness 1; rows with equal ids are ordered by a hash of their texts, rows
without id come last; repeated rows are rows of their own; a table of one row
has itself as the next; an empty table gives no rows; columns besides id and
text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, materialise

TABLES = 3
#: cells of the stored sketch, and the factor by which a failed one grows
CELLS, GROWTH = 12, 4
#: a stretch longer than this many characters is cut after chosen words
LONG = 160
#: texts and characters that are compared together
GROUP_ROWS, GROUP_CHARS = 512, 2_000_000

_SENTENCE = re.compile(r"(?<=[.!?]) +|\n")
_WORD = re.compile(r" *[^ ]+")


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text, empty ones left out."""
    out = []
    for p in _SENTENCE.split(text):
        if len(p) <= LONG:
            if p:
                out.append(p)
            continue
        at = 0
        for m in _WORD.finditer(p):
            if xxhash.xxh3_64_intdigest(m.group().strip(" ")) % 8 == 0:
                out.append(p[at:m.end()])
                at = m.end()
        if at < len(p):
            out.append(p[at:])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, digests): the paragraph digests of each text, all different
    within a text."""
    hashes, counts = [], []
    for t in texts:
        h = [xxhash.xxh3_64_intdigest(p) for p in paragraphs(t)]
        hashes += h
        counts.append(len(h))
    offsets = np.append(0, np.cumsum(counts)).astype(np.int64)
    key = np.array(hashes, np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((key, owner))
    k, o = key[order], owner[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
    at = np.arange(len(k))
    earlier = at - np.maximum.accumulate(np.where(new, at, 0))       # equal ones before
    return offsets, _mix(k + earlier.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Sketches:
    """Sketches of several digest lists, ``cells`` cells each, side by side."""

    def __init__(self, lists: int, cells: int):
        self.cells = cells
        self.count = np.zeros(lists * cells, np.int64)
        self.keys = np.zeros(lists * cells, np.uint64)
        self.checks = np.zeros(lists * cells, np.uint64)

    def places(self, owner: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
        """The cell of each digest in every table."""
        width = self.cells // TABLES
        return [owner * self.cells + t * width
                + (_mix(key + np.uint64((t + 1) * 0x1D8E4E27C47D124F % (1 << 64) ^ self.cells)) % np.uint64(width)).astype(np.int64)
                for t in range(TABLES)]

    def add(self, owner: np.ndarray, key: np.ndarray, sign: int | np.ndarray = 1) -> None:
        sign = np.broadcast_to(np.asarray(sign, np.int64), key.shape)
        factor = sign.astype(np.uint64)                              # -1 wraps to 2**64 - 1
        check = check_hash(key)
        for at in self.places(owner, key):
            np.add.at(self.count, at, sign)
            np.add.at(self.keys, at, key * factor)
            np.add.at(self.checks, at, check * factor)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take out single digests until none is left: (owner, digest, sign).
        Lists whose cells are not all empty afterwards have failed."""
        found = []
        live = np.flatnonzero((self.count == 1) | (self.count == -1))
        while len(live):
            sign = self.count[live]
            key = self.keys[live] * sign.astype(np.uint64)
            pure = (np.abs(sign) == 1) & (check_hash(key) * sign.astype(np.uint64) == self.checks[live])
            owner, key, sign = live[pure] // self.cells, key[pure], sign[pure]
            if not len(key):
                break
            order = np.lexsort((key, owner))                          # the same digest in two tables
            owner, key, sign = owner[order], key[order], sign[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            owner, key, sign = owner[first], key[first], sign[first]
            self.add(owner, key, -sign)
            found.append((owner, key, sign))
            touched = np.unique(np.concatenate(self.places(owner, key)))
            live = touched[np.abs(self.count[touched]) == 1]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*found))

    def empty(self) -> np.ndarray:
        """Whether each list has nothing left."""
        bare = (self.count == 0) & (self.keys == 0) & (self.checks == 0)
        return bare.reshape(-1, self.cells).all(axis=1)

    def packed(self) -> list[bytes]:
        """Each sketch as bytes: counts, key sums and the low half of the check sums."""
        shape = (-1, self.cells)
        parts = [self.count.astype("<i2").reshape(shape), self.keys.astype("<u8").reshape(shape),
                 self.checks.astype("<u4").reshape(shape)]
        return [b"".join(p[k].tobytes() for p in parts) for k in range(len(parts[0]))]


def check_hash(key: np.ndarray) -> np.ndarray:
    return _mix(key ^ np.uint64(0xD6E8FEB86659FD93)) & np.uint64(0xFFFFFFFF)


def _ranges(offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``which``, index) for all entries of the chosen lists."""
    sizes = offsets[which + 1] - offsets[which]
    owner = np.repeat(np.arange(len(which)), sizes)
    start = np.cumsum(sizes) - sizes
    return owner, np.arange(int(sizes.sum())) - start[owner] + offsets[which][owner]


def differences(offsets: np.ndarray, keys: np.ndarray, left: np.ndarray, right: np.ndarray,
                cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of all digests that only the left (+1) or only the
    right (-1) list of a pair holds.  Pairs that do not peel off whole are
    retried with sketches ``GROWTH`` times as large."""
    todo, out = np.arange(len(left)), []
    while len(todo):
        s = Sketches(len(todo), cells)
        for side, sign in ((left, 1), (right, -1)):
            owner, at = _ranges(offsets, side[todo])
            s.add(owner, keys[at], sign)
        owner, key, sign = s.peel()
        good = s.empty()
        out.append((todo[owner[good[owner]]], key[good[owner]], sign[good[owner]]))
        todo, cells = todo[~good], cells * GROWTH
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (
        np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))


def likeness(offsets: np.ndarray, keys: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Share of the paragraphs of both sides that are in common (1 if none)."""
    pair, _, _ = differences(offsets, keys, left, right)
    differ = np.bincount(pair, minlength=len(left))
    sizes = np.diff(offsets)
    both = sizes[left] + sizes[right]
    return np.where(both == 0, 1.0, 1.0 - differ / np.maximum(both, 1))


def edited_text(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the next one's start."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare(texts: list[str], following: np.ndarray) -> dict[str, list]:
    """The result columns of ``texts[:len(following)]``; ``following`` has the
    place of each one's next text."""
    n = len(following)
    edited = [edited_text(texts[i], texts[j]) for i, j in enumerate(following.tolist())]
    offsets, keys = digests(texts + edited)
    rows, last = np.arange(n), len(texts)
    base = Sketches(len(texts) + n, CELLS)
    owner, at = _ranges(offsets, np.arange(len(texts) + n))
    base.add(owner, keys[at])
    prints = base.packed()
    return {"n_chars": [len(t) for t in texts[:n]],
            "edited_sha256": [hashlib.sha256(e.encode()).digest() for e in edited],
            "fingerprint": prints[:n], "edited_fingerprint": prints[last:],
            "near_edited": likeness(offsets, keys, rows, rows + last),
            "near_next": likeness(offsets, keys, rows, following)}


_TYPES = {"n_chars": pa.int64(), "edited_sha256": pa.binary(), "fingerprint": pa.binary(),
          "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64()}
_FIELDS = ("n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
           "near_edited double, near_next double")
RESULT, FIRST, LAST = 0, 1, 2


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a sorted partition but the last, and its first
    and last row with their texts."""
    part = TaskContext.get().partitionId()

    def rows(kind: int, ids: pa.Array, columns: dict, text: list) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.int32()), ids,
             *(pa.array(columns[c], t) if columns else pa.nulls(n, t) for c, t in _TYPES.items()),
             pa.array(text, pa.string())], ["part", "kind", "id", *_TYPES, "text"])

    held_id, held = None, None                                         # the last row so far
    for b in batches:
        texts = b.column(1).to_pylist()
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and end - at < GROUP_ROWS and chars < GROUP_CHARS:
                chars += len(texts[end])
                end += 1
            ids, group = b.column(0).slice(at, end - at), texts[at:end]
            if held is None:
                yield rows(FIRST, ids.slice(0, 1), {}, group[:1])
            else:
                ids, group = pa.concat_arrays([held_id, ids]), [held] + group
            n = len(group) - 1
            if n:
                yield rows(RESULT, ids.slice(0, n), compare(group, np.arange(1, n + 1)), [None] * n)
            held_id, held, at = ids.slice(n, 1), group[n], end
    if held is not None:
        yield rows(LAST, held_id, {}, [held])


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows whose next text stands beside them."""
    for b in batches:
        own, after = b.column(1).to_pylist(), b.column(2).to_pylist()
        for k, pair in enumerate(zip(own, after)):
            got = compare(list(pair), np.array([1]))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), *(pa.array(got[c], t) for c, t in _TYPES.items())],
                                             ["id", *_TYPES])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next): each text's sketch, that of its edited text, and
    its likeness to the edited text and to the next document in descending
    order of ids (after the last: the first)."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("row")]
    # rows that repeat an id, or have none, are dealt out by text and row
    spread = (base.withColumn("row", F.monotonically_increasing_id())
              .repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text"))
    got = materialise(arrow_map(spread, _neighbours, f"part int, kind int, id {kind}, {_FIELDS}, text string"), "prints")
    # one short row per shuffle partition
    parts = sorted(r[0] for r in got.filter(F.col("kind") == FIRST).select("part").collect())
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    edges = (got.filter(F.col("kind") == LAST).select("part", "id", "text").join(F.broadcast(after), "part")
             .join(got.filter(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("after")), "next")
             .select("id", "text", "after"))
    rest = arrow_map(edges, _at_edges, f"id {kind}, {_FIELDS}")
    both = got.filter(F.col("kind") == RESULT).select(rest.columns).unionByName(rest)
    return both.select(F.col("id").alias(id_col), "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"),
                       F.base64("fingerprint").alias("fingerprint"),
                       F.base64("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")
