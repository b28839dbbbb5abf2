"""Spelling variant grouping over a frequency-vector trie (operator 12).

Every word has a vector: its length, then how many of its letters fall into
each letter group, groups in a fixed order.  The vectors form a trie, one level
a group.  Two words one edit apart differ by one in at most two groups: an
inserted letter is a surplus of one, a replaced one a surplus and a deficit.
The depth-first search for a word follows its own counts and may spend one
surplus and, if no letter is to be inserted, one deficit after it; the words of
the leaves that it reaches are verified letter by letter, first those that
share its first or second half, as one edit leaves one of them whole.
Deletions are the other word's insertions, and a replacement whose deficit
comes first is the other word's, so every pair is found once.

The first ``top`` levels are the key by which Spark deals the trie out: a word
is stored in one subtree and searched for in those that its budget can reach.
``top`` is the least number that leaves no subtree with more than
``SUBTREE_WORDS`` words, up to ``MOST_TOP``; subtrees that are larger all the same
are split into parts and searched part by part, so no task holds more.

A word's form is its near word of most occurrences, if it has at least twice
as many; forms lead to roots by pointer jumping.

Defined cases: a null text has no words; a null id hashes as an empty one;
repeated rows count each; near words of equal counts tie to the smaller in
code-point order; an empty table gives no rows; a long text is read in blocks
that end between runs; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, materialise

GROUPS = 16
#: groups in the order of levels: those of common letters first
FIRST_LETTERS = "eainstrol"
ORDER = list(dict.fromkeys([ord(c) % GROUPS for c in FIRST_LETTERS] + list(range(GROUPS))))
LEVEL = [ORDER.index(g) for g in range(GROUPS)]
#: fewest and most levels that make the key of a subtree
LEAST_TOP, MOST_TOP = 2, 8
#: words that one task holds of a subtree
SUBTREE_WORDS = 20_000
#: words that a trie node lists before it branches
BUCKET = 256
#: different words that a task counts before it sends them on
COUNTED = 200_000
BLOCK = 1_000_000

_RUN = re.compile("[a-zÀ-ÿ]+")
_BETWEEN = re.compile("[^A-Za-zÀ-ÿ]")

NONE, PLUS, BOTH = 0, 1, 2


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in pieces that end where no run is cut."""
    at = 0
    while at < len(text):
        gap = _BETWEEN.search(text, at + size) if at + size < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def words_of(doc_id: str, text: str, mistake_every: int, least: int, counts: Counter) -> None:
    """Add the words of a text to the counts, with the contract's deletions."""
    head = zlib.crc32(f"{doc_id}:".encode())
    for block in blocks(text):
        for run, n in Counter(_RUN.findall(block.encode().lower().decode())).items():
            h = zlib.crc32(run.encode(), head)
            if h % mistake_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                counts[run] += n


def word_counts(docs: DataFrame, mistake_every: int = 97, least_length: int = 5, least_count: int = 3,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``least_length`` letters that occur
    ``least_count`` times; counted in tasks first."""

    def run(batches):
        counts: Counter = Counter()

        def send():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                             ["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):        # one text at a time
                words_of(doc_id.as_py() or "", text.as_py() or "", mistake_every, least_length, counts)
                if len(counts) > COUNTED:
                    yield send()
        yield send()

    part = arrow_map(docs.select(F.col(f"`{id_col}`").cast("string").alias("id"),
                                 F.col(f"`{text_col}`").cast("string").alias("text")), run, "word string, n bigint")
    return part.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def vector(word: str) -> list[int]:
    """Letters per group, in the order of levels."""
    v = [0] * GROUPS
    for c in word:
        v[LEVEL[ord(c) % GROUPS]] += 1
    return v


def weights() -> list[int]:
    """A number a group, by which sums tell vectors apart."""
    return [zlib.crc32(b"%d" % g) << 24 | zlib.crc32(b"-%d" % g) >> 8 for g in range(GROUPS)]


WEIGHT = weights()
#: what an insertion, and a replacement that this side finds, add to a sum
INSERTED = frozenset(WEIGHT)
REPLACED = frozenset([0] + [WEIGHT[i] - WEIGHT[j] for i in range(GROUPS) for j in range(i + 1, GROUPS)])


def searches(word: str, top: int) -> Iterator[tuple[str, int, bool]]:
    """(key, budget spent, whether a letter is inserted) of the subtrees that
    a search enters."""
    own = vector(word)[:top]

    def key(grow, counts):
        return ",".join(map(str, [len(word) + grow, *counts]))

    for insert in (False, True):
        yield key(insert, own), NONE, insert
        for i in range(top):
            more = own[:i] + [own[i] + 1] + own[i + 1:]
            yield key(insert, more), PLUS, insert
            for j in range(i + 1, top if not insert else 0):
                if own[j]:
                    yield key(insert, more[:j] + [more[j] - 1] + more[j + 1:]), BOTH, insert


class Trie:
    """A subtree below ``top`` levels.  A node is a list of entries until it
    has more than ``BUCKET`` of them; then it branches by the next count.
    Before the search lists become leaves: entries by first and second half."""

    def __init__(self, top: int):
        self.top, self.root = top, []

    def add(self, word: str, n: int) -> None:
        v = vector(word)
        self.root = self._put(self.root, self.top, (v, sum(map(int.__mul__, v, WEIGHT)), word, n))

    def _put(self, node, level, entry):
        if isinstance(node, list):
            node.append(entry)
            if len(node) <= BUCKET or level == GROUPS:
                return node
            branches: dict = {}
            for e in node:
                branches[e[0][level]] = self._put(branches.get(e[0][level], []), level + 1, e)
            return branches
        node[entry[0][level]] = self._put(node.get(entry[0][level], []), level + 1, entry)
        return node

    def seal(self) -> None:
        """Turn lists into leaves once all words are in."""
        def leaf(node):
            if isinstance(node, dict):
                return {c: leaf(x) for c, x in node.items()}
            first, second = {}, {}
            for _, total, word, n in node:
                half = len(word) // 2
                first.setdefault(word[:half], []).append((total, word[half:], word, n))
                second.setdefault(word[half:], []).append((total, word[:half], word, n))
            return first, second
        self.root = leaf(self.root)

    def search(self, word: str, spent: int, insert: bool) -> Iterator[tuple[str, int]]:
        """Stored words that the word's remaining budget leads to."""
        v = vector(word)
        total, allowed = sum(map(int.__mul__, v, WEIGHT)), INSERTED if insert else REPLACED
        half = (len(word) + insert) // 2                    # where the words looked for are halved
        head, tail = word[:half], word[half - insert:]
        stack = [(self.root, self.top, spent)]
        while stack:
            node, level, spent = stack.pop()
            if isinstance(node, tuple):
                for other_total, rest, other, n in node[0].get(head, ()):
                    if other_total - total in allowed and edited(word[half:], rest, insert) and (other_total != total or word < other):
                        yield other, n
                for other_total, rest, other, n in node[1].get(tail, ()):
                    if (rest != head and other_total - total in allowed and edited(word[:half - insert], rest, insert)
                            and (other_total != total or word < other)):
                        yield other, n
                continue
            own = v[level]
            level += 1
            child = node.get(own)
            if child is not None:
                stack.append((child, level, spent))
            if spent == NONE:
                child = node.get(own + 1)
                if child is not None:
                    stack.append((child, level, PLUS))
            elif spent == PLUS and not insert:
                child = node.get(own - 1)
                if child is not None:
                    stack.append((child, level, BOTH))


def edited(part: str, other: str, insert: bool) -> bool:
    """Whether ``other`` is ``part`` with one letter more, or one replaced."""
    at = 0
    for a, b in zip(part, other):
        if a != b:
            break
        at += 1
    return part[at:] == other[at + 1:] if insert else at < len(part) and part[at + 1:] == other[at + 1:]


def _deal(top: int, with_searches: bool):
    """Rows (key, search, spent, inserts, word, n) of words: where each is stored
    and, with ``with_searches``, where it is searched for."""
    def run(batches):
        for b in batches:
            rows = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.append((",".join(map(str, [len(w), *vector(w)[:top]])), False, NONE, False, w, n))
                if with_searches:
                    rows += [(k, True, s, i, w, n) for k, s, i in searches(w, top)]
            if rows:
                types = (pa.string(), pa.bool_(), pa.int32(), pa.bool_(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                 ["key", "search", "spent", "inserts", "word", "n"])
    return run


_DEALT = "key string, search boolean, spent int, inserts boolean, word string, n bigint"


def _search(top: int):
    """Near pairs of a partition sorted by subtree part, stored words first."""
    def run(batches):
        at, trie, out = None, None, []

        def send():
            types = (pa.string(), pa.int64(), pa.string(), pa.int64())
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)],
                                             ["a", "na", "b", "nb"])
            out.clear()
            return got

        for b in batches:
            for key, part, search, spent, inserts, word, n in zip(*(c.to_pylist() for c in b.columns)):
                if (key, part) != at:
                    at, trie, sealed = (key, part), Trie(top), False
                if not search:
                    trie.add(word, n)
                    continue
                if not sealed:
                    trie.seal()
                    sealed = True
                out += [(word, n, other, m) for other, m in trie.search(word, spent, inserts)]
                if len(out) > 50_000:
                    yield send()
        yield send()
    return run


def key_levels(words: DataFrame, subtree_words: int) -> int:
    """The least number of key levels that leaves no subtree too large."""
    deepest = arrow_map(words, _deal(MOST_TOP, False), _DEALT)
    levels = F.array(*[F.struct(F.lit(t).alias("top"), F.substring_index("key", ",", t + 1).alias("k"))
                       for t in range(LEAST_TOP, MOST_TOP)])
    sizes = deepest.select(F.explode(levels).alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    most = {r["top"]: r["n"] for r in sizes.groupBy("l.top").agg(F.max("n").alias("n")).collect()}   # a row a level
    return min((t for t, n in most.items() if n <= subtree_words), default=MOST_TOP if most else LEAST_TOP)


def near_pairs(words: DataFrame, subtree_words: int = SUBTREE_WORDS) -> DataFrame:
    """(a, na, b, nb): every unordered pair of words one edit apart, once."""
    top = key_levels(words, subtree_words)
    stored = arrow_map(words, _deal(top, False), _DEALT)
    sizes = stored.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / subtree_words).cast("int").alias("parts"))
    dealt = (arrow_map(words, _deal(top, True), _DEALT).join(sizes, "key")      # no search where nothing is stored
             .withColumn("part", F.explode(F.when(F.col("search"), F.sequence(F.lit(0), F.col("parts") - 1))
                                           .otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")))))
             .repartition("key", "part").sortWithinPartitions("key", "part", "search")
             .select("key", "part", "search", "spent", "inserts", "word", "n"))
    return arrow_map(dealt, _search(top), "a string, na bigint, b string, nb bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last one.
    Every round doubles the steps taken, and counts at least double a step."""
    state = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        state = materialise(state.join(ahead, "root", "left").select(
            "word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        if state.filter("moved").isEmpty():
            return state.select("word", "root")
        state = state.select("word", "root")


def variant_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mistake_every: int = 97,
                   least_length: int = 5, least_count: int = 3, ratio: float = 2.0,
                   subtree_words: int = SUBTREE_WORDS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of the corpus."""
    words = materialise(word_counts(docs, mistake_every, least_length, least_count, id_col, text_col), "words")
    pairs = materialise(near_pairs(words, subtree_words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    follow = -F.col("best.m") >= ratio * F.col("n")
    rows = materialise(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(follow, F.col("best.near")).alias("form"), F.when(follow, -F.col("best.m")).alias("form_n")), "forms")
    last = roots(rows.filter("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                                                  "form_n")
