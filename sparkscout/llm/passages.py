"""Repeated passages by winnowing over words (operator 6).

The unit is a word, so a passage is found wherever it stands: inside longer
lines, or with other line breaks and spaces.  A *window* is any run of
``min_words`` words.  It selects the ``GRAM`` words of least hash in it (the
last of equal ones) as its fingerprint.  The choice depends on the window
alone, so two documents that share a window share its fingerprint, and only
about one place in twenty is one (of 50 words).  Consecutive windows that
select one place are its *stretch*.

Fingerprints that come up once only are dropped.  Of the others, equal
stretches are compared as a whole: all but the first, in the order of (id,
place), are repeats.  Windows are listed and compared one by one only for the
first places of different stretches under one fingerprint, that is at the ends
of what texts have in common, or at the edges of the blocks in which a long
text is read.  Nothing is compared with all the others.

What is deleted is exactly: every word in a run of at least ``min_words``
words that stands, word by word, at an earlier place.

Defined cases: null text stays null; empty text stays empty; a line goes as a
whole if all its words go, a line without words if it stands inside a deleted
run, and of other lines the words with the space after them; rows that repeat
id and text are one document, so each of them keeps the same text; null ids
come first; of rows that share an id with different texts the order is by text
hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, free_names, materialise, slices, take_over

#: words of a fingerprint; words of several texts, or windows of a long one, that are hashed at once
GRAM, CHUNK = 8, 1 << 16
#: bytes of words that are hashed at once; longer words get a hash of their own
BYTES, LONG_WORD = 1 << 18, 1 << 16
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: white space of one byte, and any other
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_OTHER_SPACE = re.compile("[^\\S\t-\r\x1c- ]")


class _Powers:
    """Powers of the base and of its inverse, as many as were ever needed."""

    def __init__(self):
        self.forth = self.back = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.forth) < n:
            for name, base in (("forth", _BASE), ("back", _BACK)):
                power = np.full(n, base, np.uint64)
                power[0] = 1
                setattr(self, name, np.cumprod(power))
        return self.forth[:n], self.back[:n]


_POWERS = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in bytes that end with white space."""
    gap = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.append(0, edge)
    return edge[::2], edge[1::2]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words one after another, words of each text)."""
    parts = [(t if t.isascii() else _OTHER_SPACE.sub(" ", t)).encode() for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    start, end = _edges(data)
    ends_of = np.cumsum([len(p) + 1 for p in parts])
    sizes = np.diff(np.searchsorted(start, ends_of), prepend=0)
    out, lo = np.empty(len(start), np.uint64), 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + BYTES)))
        first, last = start[lo:hi] - start[lo], end[lo:hi] - start[lo]
        if hi == lo + 1 and last[0] > LONG_WORD:
            out[lo] = xxhash.xxh3_64_intdigest(data[start[lo]:end[lo]].tobytes())
        else:
            forth, back = _POWERS.upto(BYTES + 1)
            upto = np.zeros(last[-1] + 1, np.uint64)
            np.cumsum(data[start[lo]:end[hi - 1]] * forth[:last[-1]], out=upto[1:])
            h = (upto[last] - upto[first]) * back[first]
            out[lo:hi] = _mix(h + (last - first).astype(np.uint64) * np.uint64(_BACK))
            for k in np.flatnonzero(last - first > LONG_WORD):
                out[lo + k] = xxhash.xxh3_64_intdigest(data[start[lo + k]:end[lo + k]].tobytes())
        lo = hi
    return out, sizes


class Words:
    """Word hashes of some texts one after another, and hashes of their runs."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray):
        self.sizes = np.asarray(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = len(hashes)
        forth, self.back = _POWERS.upto(max(n + 1, CHUNK))
        self.upto = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * forth[:n], out=self.upto[1:])

    def runs(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from first on and before end."""
        return _mix((self.upto[end] - self.upto[first]) * self.back[first])

    def stretches(self, min_words: int) -> tuple[np.ndarray, ...]:
        """(text, first window, windows, fingerprint, hash of the stretch) of
        each selected place; windows by their first word in the text."""
        gram = min(GRAM, (min_words + 1) // 2)
        span, n = min_words - gram + 1, len(self.upto) - 1
        many = np.maximum(self.sizes - min_words + 1, 0)             # windows of each text
        if not many.any():
            none = np.zeros(0, np.int64)
            return none, none, none, none.view(np.uint64), none.view(np.uint64)
        g = self.runs(np.arange(n - gram + 1), np.arange(gram, n + 1))
        best, wide = np.arange(len(g)), 1
        while wide < span:                                           # places of the least of `wide` hashes
            step = min(wide, span - wide)
            a, b = best[:-step], best[step:]
            best, wide = np.where(g[b] <= g[a], b, a), wide + step
        text = np.repeat(np.arange(len(many)), many)
        at = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        window = at + self.starts[text]
        place = best[window]
        head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
        count = np.diff(np.append(head, len(place)))
        first, text, at, place = window[head], text[head], at[head], place[head]
        shape = ((place - first) << 32 | count).astype(np.uint64)
        whole = _mix(self.runs(first, first + count + min_words - 1) ^ _mix(shape))
        return text, at, count, g[place], whole


def _chunks(texts: pa.Array, min_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, Words]]:
    """(rows, first word of each in its text, words) of some texts at a time; a
    long text comes in blocks that share all words of windows over their edge."""
    rows, held, chars = [], [], 0

    def blocks():
        hashes, sizes = word_hashes(held)
        at, head, rest = 0, 0, []                             # rest: (row, from, until) of short texts
        for r, n in zip(rows, sizes.tolist()):
            if n > CHUNK:
                if rest:
                    yield np.asarray(rest), np.zeros(len(rest), np.int64), Words(hashes[head:at], few)
                for k in range(0, n - min_words + 1, CHUNK):
                    part = hashes[at + k:at + min(n, k + CHUNK + min_words - 1)]
                    yield np.asarray([r]), np.asarray([k]), Words(part, [len(part)])
                at, rest = at + n, []
                head = at
                continue
            if not rest:
                few = []
            rest.append(r), few.append(n)
            at += n
            if at - head > CHUNK:
                yield np.asarray(rest), np.zeros(len(rest), np.int64), Words(hashes[head:at], few)
                head, rest = at, []
        if rest:
            yield np.asarray(rest), np.zeros(len(rest), np.int64), Words(hashes[head:at], few)

    for r, t in enumerate(texts):
        text = t.as_py() or ""
        rows.append(r), held.append(text)
        chars += len(text)
        if chars >= 4 * CHUNK:
            yield from blocks()
            rows, held, chars = [], [], 0
    if rows:
        yield from blocks()


def stretch_table(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, text_hash, first, n, print, whole): one row per selected place of
    (id, text_hash, text)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("passages", lambda: None)
        for b in batches:
            for rows, base, words in _chunks(b.column(2), min_words):
                text, at, n, mark, whole = words.stretches(min_words)
                at = at + base[text]
                take = pa.array(rows[text])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(at.astype(np.int32)),
                     pa.array(n.astype(np.int32)), pa.array(mark.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["id", "text_hash", "first", "n", "print", "whole"])

    return arrow_map(docs, run, f"id {kind}, text_hash bigint, first int, n int, print bigint, whole bigint")


def _window_table(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, text_hash, first, print, window): the windows of the listed
    stretches of (id, text_hash, text, edges)."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("passages", lambda: None)
        for b in batches:
            for rows, base, words in _chunks(b.column(2), min_words):
                edges = b.column(3).take(pa.array(rows))
                flat = edges.flatten()
                text = np.repeat(np.arange(len(rows)), edges.value_lengths().to_numpy(zero_copy_only=False))
                n = flat.field("n").to_numpy()
                each = np.repeat(np.arange(len(n)), n)
                at = flat.field("first").to_numpy().astype(np.int64)[each] + (
                    np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))
                inner = at - base[text[each]]                     # of a long text, those of this block
                here = (inner >= 0) & (inner < np.minimum(CHUNK, words.sizes[text[each]] - min_words + 1)
                                       if len(rows) == 1 else inner >= 0)
                each, at, inner = each[here], at[here], inner[here]
                start = inner + words.starts[text[each]]
                window = words.runs(start, start + min_words)
                take = pa.array(rows[text[each]])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(at.astype(np.int32)),
                     flat.field("print").take(pa.array(each)), pa.array(window.view(np.int64))],
                    ["id", "text_hash", "first", "print", "window"])

    return arrow_map(docs, run, f"id {kind}, text_hash bigint, first int, print bigint, window bigint")


def _join_texts(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """The rows of (id, text_hash, ...) with the other columns of ``found``."""
    other = found.withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
    return docs.join(other, docs["id"].eqNullSafe(other["_id"]) & (docs["text_hash"] == other["_hash"]),
                     how).drop("_id", "_hash")


def repeated_words(texts: DataFrame, min_words: int) -> DataFrame:
    """(id, text_hash, first, last): runs of words of (id, text_hash, text)
    that stand earlier already, by first and last word in the text."""
    place = F.struct("id", "text_hash", "first")
    # tables are written before they are joined: a join straight onto an aggregate
    # keeps its partitions, and a hot passage would stay in one task
    prints = materialise(stretch_table(texts, min_words), "stretches")
    shared = materialise(prints.groupBy("print").count().filter("count > 1").select("print"), "shared")
    spots = materialise(prints.join(shared, "print", "left_semi"), "places")
    origin = materialise(spots.groupBy("print", "whole", "n").agg(F.min(place).alias("o")), "origins")
    copies = (spots.join(origin.select("print", "whole", "o"), ["print", "whole"])
              .filter(~place.eqNullSafe(F.col("o")))
              .select("id", "text_hash", "first", (F.col("first") + F.col("n") + (min_words - 2)).alias("last")))
    mixed = materialise(origin.groupBy("print").count().filter("count > 1").select("print"), "mixed")
    edges = (origin.join(mixed, "print", "left_semi").select("o.id", "o.text_hash", "o.first", "n", "print")
             .groupBy("id", "text_hash").agg(F.collect_list(F.struct("first", "n", "print")).alias("edges")))
    windows = materialise(_window_table(_join_texts(texts, materialise(edges, "edges"), "inner"), min_words),
                          "windows")
    earlier = materialise(windows.groupBy("print", "window").agg(F.min(place).alias("o"), F.max(place).alias("z"))
                          .filter(~F.col("o").eqNullSafe(F.col("z"))).drop("z"), "earlier")
    parts = (windows.join(earlier, ["print", "window"]).filter(~place.eqNullSafe(F.col("o")))
             .select("id", "text_hash", "first", (F.col("first") + (min_words - 1)).alias("last")))
    return copies.union(parts)


def delete_words(text: str, runs: list[tuple[int, int]]) -> tuple[str, int, int]:
    """Text without the words of the runs, lines deleted as a whole, words."""
    first, last = np.asarray(runs, np.int64).reshape(-1, 2).T
    out, lines, words = delete_runs([text], np.zeros(len(runs), np.int64), first, last)
    return out[0].as_py(), int(lines[0]), int(words[0])


def delete_runs(texts: list[str], text: np.ndarray, first: np.ndarray,
                last: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts without the words of the runs, lines deleted as a whole, words);
    runs by text, first and last word in it.  All texts are cut at once."""
    parts = [t.encode() for t in texts]
    after = np.cumsum([len(p) + 1 for p in parts])                   # every text ends with a line feed
    begin = np.append(0, after[:-1])
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    start, end = _edges(data if all(map(str.isascii, texts)) else np.frombuffer(
        b"\n".join([_OTHER_SPACE.sub(lambda m: " " * len(m[0].encode()), t).encode() for t in texts]) + b"\n", np.uint8))
    n, base = len(start), np.searchsorted(start, begin)
    i, j = base[text] + first, base[text] + last
    opened = np.bincount(i, minlength=n + 1)
    gone = np.cumsum(opened - np.bincount(j + 1, minlength=n + 1))[:n] > 0
    inside = np.cumsum(opened - np.bincount(j, minlength=n + 1)) > 0  # of a word and the next one
    words = np.append(0, np.cumsum(gone))

    stop = np.flatnonzero(data == 10)                                # lines: bytes, and words from head_word on
    head, next_word = np.append(0, stop[:-1] + 1), np.searchsorted(start, stop)
    head_word = np.append(0, next_word[:-1])
    some = next_word > head_word
    whole = np.where(some, words[next_word] - words[head_word] == next_word - head_word, inside[head_word - 1])
    tops, tails = np.zeros(n + 1, bool), np.zeros(n + 1, bool)       # first and last words of lines
    tops[head_word[some]] = tails[next_word[some] - 1] = True
    tops, tails = tops[:n], tails[:n]
    part = gone & ~np.repeat(whole, next_word - head_word)
    i = np.flatnonzero(part & (tops | ~np.append(False, gone[:-1])))
    j = np.flatnonzero(part & (tails | ~np.append(gone[1:], False)))
    at_end = tails[j]                                                # with the space before, others with that after

    cut = np.zeros(len(data) + 1, np.int8)
    for lo, hi in ((head[whole], stop[whole] + 1), (end[i[at_end] - 1], end[j[at_end]]),
                   (start[i[~at_end]], start[j[~at_end] + 1])):
        cut[lo] += 1
        cut[hi] -= 1
    keep = np.cumsum(cut[:-1], dtype=np.int8) == 0
    stays = np.append(-1, stop[~whole])                              # the last line left ends without a line feed
    final = stays[np.searchsorted(stays, after) - 1]
    keep[final[final >= begin]] = False
    ends = np.append(0, np.cumsum(np.add.reduceat(keep, begin, dtype=np.int64)))
    out = pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[keep]))
    lines = np.add.reduceat(whole, np.searchsorted(head, begin), dtype=np.int64)
    return out, lines, words[np.append(base[1:], n)] - words[base]


def _marked(docs: DataFrame, deleted: str, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """All rows and columns, and the runs of words to delete, by first and last
    word in the text."""
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    run_id, run_hash = free_names(docs.columns, "_run_id", "_run_hash")
    found = (repeated_words(texts, min_words).groupBy("id", "text_hash")
             .agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias(deleted))
             .withColumnsRenamed({"id": run_id, "text_hash": run_hash}))
    return docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(run_id)) & (F.xxhash64(text) == F.col(run_hash)),
                     "left").drop(run_id, run_hash)


def _cleaned(texts: pa.Array, deleted: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts without the words of their runs, lines and words deleted)."""
    count = pc.fill_null(pc.list_value_length(deleted), 0).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero((count > 0) & texts.is_valid().to_numpy(zero_copy_only=False))
    lines, words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    if not len(hit):
        return texts, lines, words
    runs = deleted.take(pa.array(hit)).flatten()
    first, last = (runs.field(k).to_numpy().astype(np.int64) for k in ("first", "last"))
    out, lines[hit], words[hit] = delete_runs(texts.take(pa.array(hit)).to_pylist(),
                                              np.repeat(np.arange(len(hit)), count[hit]), first, last)
    place = np.arange(len(texts))
    place[hit] = len(texts) + np.arange(len(hit))
    return pa.concat_arrays([texts, out]).take(pa.array(place)), lines, words


def rewrite(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text",
            chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns, with later repeats of passages deleted from the
    text, and ``chars_col``, where there is one, counted anew for such rows."""
    deleted, changed = free_names(docs.columns, "_deleted", "_changed")
    marked = _marked(docs, deleted, min_words, id_col, text_col)
    names = docs.columns
    at = names.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("passages", lambda: None)
        for b in slices(batches, at):
            out, _, words = _cleaned(b.column(at), b.column(len(names)))
            cols = list(b.columns[:len(names)])
            cols[at] = out
            yield pa.RecordBatch.from_arrays([*cols, pa.array(words > 0)], [*names, changed])

    out = arrow_map(marked, run, f"{fields}, `{changed}` boolean")
    if chars_col in names:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.when(F.col(changed), F.length(text_col).cast(kind)).otherwise(F.col(chars_col)))
    return out.drop(changed)


def dedup_passages(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id_col, text, n_deleted_lines, n_deleted_words, deleted): every
    document with later repeats of passages deleted; ``deleted`` are the runs,
    by first and last word in the original text."""
    marked = _marked(docs.select(id_col, F.col(text_col).cast("string").alias("text")), "_deleted", min_words, id_col, "text")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("passages", lambda: None)
        for b in slices(batches, 1):
            out, lines, words = _cleaned(b.column(1), b.column(2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), out, pa.array(lines), pa.array(words), b.column(2)],
                [id_col, "text", "n_deleted_lines", "n_deleted_words", "deleted"])

    return arrow_map(marked, run, f"`{id_col}` {kind}, text string, n_deleted_lines bigint, "
                     "n_deleted_words bigint, deleted array<struct<first:int,last:int>>")
