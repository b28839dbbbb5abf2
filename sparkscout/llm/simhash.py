"""SimHash near-duplicates with covering locality-sensitive hashing
(operator 2).

Every bit position of a fingerprint gets a non-zero vector of ``radius + 1``
bits.  Each non-zero vector ``v`` of that length defines a mask: the positions
whose vector has an odd inner product with ``v``.  Any ``radius`` positions
span at most ``radius`` dimensions, so some ``v`` is orthogonal to them all:
its mask keeps none of them.  Two fingerprints within the radius therefore
agree on at least one of the ``2^(radius+1) - 1`` masks, whatever their
differing bits.  Collisions are checked by their bit distance.

Equal fingerprints are one vertex.  Inside a bucket a search over the
not yet reached members yields a spanning forest, never all pairs.  Members of
buckets beyond ``max_bucket`` are linked exactly another way: two fingerprints
within an even radius r share a point within r/2 of both, and all that share
such a point are within r of each other, so a star per point loses no link.

Defined cases: null, empty or blank text has fingerprint zero and is linked
like any other; repeated rows keep one output row each; a null id never
becomes a component id unless its component has no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import arrow_map, free_names, materialise, take_over
from .components import components

BITS = 64
#: rows of a document's shingle bits that are counted at once
_BLOCK = 1 << 16


def text_fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned fingerprint of one whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[lo:hi - 1], seed)
                  for lo, hi in zip([0, *ends], ends[shingle - 1:])]
    ones = np.zeros(BITS, np.int64)
    h = np.asarray(hashes, "<u8")
    for at in range(0, len(h), _BLOCK):
        part = h[at:at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _hashed(texts: DataFrame, shingle: int, seed: int, id_col: str) -> DataFrame:
    """(id_col, text_hash, fp) of (id, text hash, text)."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("simhash", lambda: None)
        for b in batches:
            fp = np.asarray([text_fingerprint(t.as_py(), shingle, seed) for t in b.column(2)], "<u8")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view("<i8"))],
                                             [id_col, "text_hash", "fp"])

    return arrow_map(texts, run, f"`{id_col}` {kind}, text_hash bigint, fp bigint")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id_col, fp): signed 64-bit fingerprint of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("simhash", lambda: None)
        for b in batches:
            fp = np.asarray([text_fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], "<u8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view("<i8"))], [id_col, "fp"])

    return arrow_map(docs.select(id_col, F.col(text_col).cast("string")), run,
                     f"`{id_col}` {kind}, fp bigint")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The ``2^(radius+1) - 1`` masks as unsigned integers."""
    top = 1 << (radius + 1)
    vector = [1 + i % (top - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (vector[i] & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of values within the radius:
    each reached value looks at the not yet reached ones once."""
    out, rest = [], values
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                rest = rest[~near]
    return out


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = []
            for members in b.column(0):
                pairs += spanning_links(members.values.to_numpy().view("<u8"), radius)
            flat = np.asarray(pairs, "<u8").reshape(-1, 2).view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["a", "b"])
    return run


def _ball(reach: int):
    flips = np.asarray([sum(1 << i for i in c) for k in range(reach + 1)
                        for c in combinations(range(BITS), k)], "<u8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view("<u8")
            for x in fp:
                yield pa.RecordBatch.from_arrays(
                    [pa.array((flips ^ x).view("<i8")),
                     pa.array(np.full(len(flips), x).view("<i8"))], ["point", "fp"])
    return run


def links(fps: DataFrame, radius: int = 4, max_bucket: int = 16_384) -> DataFrame:
    """(a, b): links between distinct fingerprints within the radius, enough
    of them that the components are those of all such links."""
    if radius % 2:
        raise ValueError("the exact path for very large buckets takes an even radius")
    masks = covering_masks(radius)
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m))))
                     for k, m in enumerate(masks)])
    rows = fps.select("fp").distinct().select("fp", F.explode(keys).alias("bucket"))
    shared = materialise(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("a"),
                                                    F.max("fp").alias("b")).filter("n > 1"), "buckets")
    twos = (shared.filter("n = 2").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
            .select("a", "b"))
    middle = rows.join(shared.filter((F.col("n") > 2) & (F.col("n") <= max_bucket)).select("bucket"),
                       "bucket")
    more = arrow_map(middle.groupBy("bucket").agg(F.sort_array(F.collect_list("fp")).alias("members"))
                     .select("members"), _bucket_links(radius), "a bigint, b bigint")
    out = twos.union(more)
    crowded = shared.filter(F.col("n") > max_bucket)
    if not crowded.isEmpty():
        dense = rows.join(crowded.select("bucket"), "bucket", "left_semi").select("fp").distinct()
        near = arrow_map(dense, _ball(radius // 2), "point bigint, fp bigint")
        stars = near.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
        out = out.union(near.join(stars.select("point", "a"), "point").filter("a <> fp")
                        .select("a", F.col("fp").alias("b")))
    return out.distinct()


def _rooted(fps: DataFrame, radius: int, max_bucket: int, id_col: str) -> DataFrame:
    """(fp, root, component): of each fingerprint the key of its component,
    and the least id in it (null: none has an id)."""
    first = fps.groupBy("fp").agg(F.min(id_col).alias("_first"))
    roots = components(links(fps, radius, max_bucket))
    rooted = (first.join(roots, first["fp"] == roots["v"], "left")
              .select("fp", "_first", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("_first").alias("component"))
    return materialise(rooted.join(least, "root").select("fp", "root", "component"), "components")


def simhash_groups(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42,
                   max_bucket: int = 16_384, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(id_col, fp, component): one row per document, ``component`` being the
    least id of all documents reachable over links."""
    fps = materialise(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    return fps.join(_rooted(fps, radius, max_bucket, id_col), "fp").select(id_col, "fp", "component")


def keep_first(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One document of each group: the one with the least id, a null id coming
    last (of rows that share this id, the one with the least text)."""
    key, root, least, place = free_names(docs.columns, "_key", "_root", "_least", "_place")
    text = F.col(text_col).cast("string")
    fps = materialise(_hashed(docs.select(id_col, F.xxhash64(text), text), shingle, 42, id_col), "fingerprints")
    groups = _rooted(fps, radius, 16_384, id_col)
    # the rows of a group that have its least id: most often one
    stay = materialise(fps.join(groups, "fp").filter(F.col(id_col).eqNullSafe(F.col("component")))
                       .select(F.col(id_col).alias(least), F.col("text_hash").alias(key), F.col("root").alias(root))
                       .distinct(), "survivors")
    kept = docs.join(stay, docs[id_col].eqNullSafe(stay[least])
                     & (F.xxhash64(docs[text_col].cast("string")) == stay[key])).drop(least, key)
    order = Window.partitionBy(root).orderBy(text_col)
    return kept.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place, root)
