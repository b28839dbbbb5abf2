"""Binary token store with a minimal perfect hash index (operator 7).

A store is a folder of shard pairs in a file system that all executors share:

* ``<shard>.ids``: the ids of the shard's documents in ascending key order,
  little-endian, 2 or 4 bytes each (by the vocabulary), nothing between them;
* ``<shard>.mph``: the index.  A minimal perfect hash maps each key of the
  shard to a slot in 0..n-1; the slot holds a 32-bit fingerprint of the key,
  the offset of its first id and the number of its ids.

The hash is a cascade of bit arrays: a key sits in the first level where it
alone hits its bit, and its slot is the rank of that bit.  A lookup reads a
few bits, one slot and one slice of payload, whatever the shard's size; a key
that was never stored is told by its fingerprint (but for 1 in 2^32).

``manifest`` (Parquet) names the shard files of the tasks that succeeded, so a
task that ran twice leaves an unnamed file and no wrong data.

Defined cases: a null or empty text stores the end id alone; a null key is the
key ``null`` and sorts first; rows that repeat a key are told apart by their
ordinal in text order (the key's hash input is ``key#ordinal`` from ordinal 1).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import arrow_map
from .tokenizing import encoder

MAGIC = b"TOKMPH01"
#: bits per remaining key at each level of the hash
GAMMA = 2.0
MAX_LEVELS = 64
MANIFEST = "lo {0}, hi {0}, n_docs bigint, n_tokens bigint, name string"


def open_fs(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and inner path of a URI or a plain path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    path = path.replace("s3a://", "s3://", 1)
    return pa.fs.FileSystem.from_uri(path)


def key_hashes(keys: list[str]) -> np.ndarray:
    """Two 64-bit hashes per key: one for the levels, one for fingerprints."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(digest(k.encode()) for k in keys), "<u8").reshape(-1, 2)


def _level_hash(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(size)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit key hashes."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels                                   # boolean arrays
        counts = np.cumsum([0, *(int(b.sum()) for b in levels)])
        self.ranks = [np.cumsum(b) - 1 + c for b, c in zip(levels, counts)]

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two keys of a shard share a 64-bit hash")
        levels, rest = [], hashes
        while len(rest):
            if len(levels) == MAX_LEVELS:
                raise ValueError("perfect hash did not settle")
            size = max(64, int(len(rest) * GAMMA))
            at = _level_hash(rest, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; -1 where no level has its bit."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            at = _level_hash(hashes[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        return out


def index_bytes(keys: list[str], offsets: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    h = key_hashes(keys)
    mph = PerfectHash.build(h[:, 0])
    slot = mph.slots(h[:, 0])
    table = np.zeros(len(keys), [("print", "<u4"), ("count", "<u4"), ("offset", "<u8")])
    table["print"][slot] = (h[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    table["count"][slot] = counts
    table["offset"][slot] = offsets
    head = json.dumps({"n": len(keys), "width": width, "levels": [len(b) for b in mph.levels]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head,
                     *(np.packbits(b).tobytes() for b in mph.levels), table.tobytes()])


class ShardIndex:
    """A read ``.mph`` file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token store index")
        at = 12 + int.from_bytes(data[8:12], "little")
        head = json.loads(data[12:at])
        self.width, levels = head["width"], []
        for size in head["levels"]:
            n = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, n, at), count=size).astype(bool))
            at += n
        self.mph = PerfectHash(levels)
        self.table = np.frombuffer(data, [("print", "<u4"), ("count", "<u4"), ("offset", "<u8")],
                                   head["n"], at)

    def find(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offset, count) in ids of each key; count -1 for an unknown key."""
        h = key_hashes(keys)
        slot = self.mph.slots(h[:, 0])
        row = self.table[np.maximum(slot, 0)] if len(self.table) else np.zeros(len(keys), self.table.dtype)
        known = (slot >= 0) & (row["print"] == (h[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        return row["offset"].astype(np.int64), np.where(known, row["count"].astype(np.int64), -1)


class Ordinals:
    """Store keys for ids that come in ascending order."""

    def __init__(self):
        self.last, self.n = object(), 0

    def keys(self, ids: list) -> list[str]:
        out = []
        for i in ids:
            self.n = self.n + 1 if i == self.last else 0
            self.last = i
            name = "null" if i is None else str(i)
            out.append(f"{name}#{self.n}" if self.n else name)
        return out


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int,
                spaces_matter: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the store.

    Rows go to shards by ranges of the key, one per shuffle partition; a task
    streams its payload to the shared folder, so it holds one batch of texts
    and 16 bytes and a key per document.  Returns the manifest: shard, lo, hi
    (keys), n_docs, n_tokens, base (ids before the shard), name.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, spaces_matter)
        width = 2 if max(len(enc.edge), end_id + 1) <= 1 << 16 else 4
        end = np.asarray([end_id], f"<u{width}").tobytes()
        fs, folder = open_fs(path)
        name = f"shard-{uuid.uuid4().hex}"
        ordinals, keys, counts, lo, hi, out = Ordinals(), [], [], None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_pylist()
            if out is None:
                fs.create_dir(folder, recursive=True)
                out, lo = fs.open_output_stream(f"{folder}/{name}.ids"), ids[0]
            hi = ids[-1]
            keys += ordinals.keys(ids)
            for data in enc.encode_many(b.column(1).to_pylist()):
                if width == 2:
                    data = np.frombuffer(data, "<u4").astype("<u2").tobytes()
                out.write(data + end)
                counts.append(len(data) // width + 1)
        if out is None:
            return
        out.close()
        counts = np.asarray(counts, np.int64)
        with fs.open_output_stream(f"{folder}/{name}.mph") as f:
            f.write(index_bytes(keys, np.cumsum(counts) - counts, counts, width))
        yield pa.RecordBatch.from_arrays(
            [pa.array([lo], b.schema.types[0]), pa.array([hi], b.schema.types[0]),
             pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()),
             pa.array([name])], ["lo", "hi", "n_docs", "n_tokens", "name"])

    ranged = (docs.select(id_col, F.col(text_col).cast("string").alias("text"))
              .repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col, "text"))
    shards = arrow_map(ranged, run, MANIFEST.format(kind))
    shards.write.parquet(f"{path}/manifest")
    return read_manifest(docs.sparkSession, path, kind)


def read_manifest(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """One row per shard, in key order, with the number of ids before it.
    (The window runs over one small row per shard, not over data.)"""
    m = spark.read.schema(MANIFEST.format(kind)).parquet(f"{path}/manifest")
    w = Window.orderBy(F.col("lo").asc_nulls_first())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return m.select((F.row_number().over(w) - 1).alias("shard"), "lo", "hi", "n_docs", "n_tokens",
                    F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), "name")


def lookup(keys: DataFrame, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Keyed access: for each row of ``keys`` (a repeated key asks for its
    ordinals in turn) id_col, start (ids before it in the whole store),
    n_tokens, ids_crc32 and, if asked for, ids.  Unknown keys give nulls.

    The shard bounds (one short row per shard) go to every task; a task reads
    the index of each shard it needs once and of the payload the slices it
    asks for, in ascending order.
    """
    kind = keys.schema[id_col].dataType.simpleString()
    shards = read_manifest(keys.sparkSession, path, kind).orderBy("shard").collect()
    bounds = [(s["lo"], s["hi"], s["base"], s["name"]) for s in shards]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = open_fs(path)
        ordinals, at, index, payload = Ordinals(), -1, None, None
        names = [id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        for b in batches:
            ids = b.column(0).to_pylist()
            stored = ordinals.keys(ids)
            start, count, crc, all_ids = [], [], [], []
            k = 0
            while k < len(ids):
                s = max(at, 0)
                while s < len(bounds) and _after(ids[k], bounds[s][1]):
                    s += 1
                stop = k + 1
                if s == len(bounds) or _after(bounds[s][0], ids[k]):     # in no shard
                    found = (np.zeros(1, np.int64), np.full(1, -1))
                else:
                    while stop < len(ids) and not _after(ids[stop], bounds[s][1]):
                        stop += 1
                    if s != at:
                        at = s
                        with fs.open_input_stream(f"{folder}/{bounds[s][3]}.mph") as f:
                            index = ShardIndex(f.read())
                        payload = fs.open_input_file(f"{folder}/{bounds[s][3]}.ids")
                    found = index.find(stored[k:stop])
                for offset, n in zip(*map(np.ndarray.tolist, found)):
                    if n < 0:
                        start.append(None), count.append(None), crc.append(None), all_ids.append(None)
                        continue
                    raw = payload.read_at(n * index.width, offset * index.width)
                    wide = np.frombuffer(raw, f"<u{index.width}").astype("<u4")
                    start.append(bounds[s][2] + offset)
                    count.append(n)
                    crc.append(zlib.crc32(wide.tobytes()))
                    if with_ids:
                        all_ids.append(wide.astype("<i4"))
                k = stop
            cols = [b.column(0), *(pa.array(x, pa.int64()) for x in (start, count, crc))]
            if with_ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names)

    ordered = keys.select(id_col).repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col)
    return arrow_map(ordered, run, f"`{id_col}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
                     + ", ids array<int>" * with_ids)


def _after(a, b) -> bool:
    """a > b with null before everything."""
    return a is not None and (b is None or a > b)
