"""Best-fit packing with large-item matching (operator 9).

Only lengths decide where a piece goes, and there are at most ``capacity``
different lengths.  So the packing is solved on the histogram of lengths: its
size does not grow with the corpus.  Two pieces above a third of the capacity
fit a sequence at most twice; the longest is matched with the longest that
still fits beside it, whole classes at once.  Shorter pieces then go, longest
first, to the fullest sequence with room for them (best fit), and open new
ones when none has.  The solution is a list of runs: the next ``count`` pieces
of a length go to consecutive sequences at one offset.  Every piece finds its
run by its position in the order of (length, key, piece), which Spark gets
from a range sort and the sizes of the sorted partitions.

Defined cases: a null or empty text is its end id alone; repeated rows are
separate pieces; an empty table packs to no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, materialise, slices
from .tokenizing import encoder


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n ids: whole sequences, the remainder
    first."""
    rest = n % capacity
    return [rest] * bool(rest) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int,
           spaces_matter: bool = True, id_col: str = "doc_id", text_col: str = "text",
           keep_ids: bool = False) -> DataFrame:
    """Encode every whole text, append the end id and cut what is longer than
    ``capacity``: id_col, piece, start, length, ids_crc32 and, with
    ``keep_ids``, ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, spaces_matter)
        end = np.asarray([end_id], "<u4").tobytes()
        for b in slices(batches, 1):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for r, data in enumerate(enc.encode_many(b.column(1).to_pylist())):
                data += end
                lengths = cut_lengths(len(data) // 4, capacity)
                for k, (n, at) in enumerate(zip(lengths, accumulate(lengths, initial=0))):
                    part = data[4 * at:4 * (at + n)]
                    row.append(r), piece.append(k), start.append(at), length.append(n)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return arrow_map(docs.select(id_col, F.col(text_col).cast("string")), run,
                     f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
                     + ", ids array<int>" * keep_ids)


def plan_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Runs (length, count, first sequence, offset): the next ``count`` pieces
    of a length go to consecutive sequences from ``first`` at ``offset``.
    Works on counts, so its cost does not depend on the number of pieces."""
    left = {n: c for n, c in histogram.items() if c}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError(f"piece lengths must be from 1 to {capacity}")
    runs: list[tuple[int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}       # free space -> (first sequence, count)
    made = 0

    def place(n: int, count: int, first: int, used: int) -> None:
        runs.append((n, count, first, used))

    def leave(free: int, first: int, count: int) -> None:
        if free and count:
            room.setdefault(free, []).append((first, count))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and m <= n
                         and left[m] > (m == n)), None)
            count = left[n] if mate is None else (left[n] // 2 if mate == n else min(left[n], left[mate]))
            place(n, count, made, 0)
            left[n] -= count
            if mate is not None:
                place(mate, count, made, n)
                left[mate] -= count
            leave(capacity - n - (mate or 0), made, count)
            made += count

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            free = min((g for g in room if g >= n), default=None)
            if free is None:
                per = capacity // n
                first, count, free = made, -(-todo // per), capacity
                made += count
            else:
                first, count = room[free].pop()
                if not room[free]:
                    del room[free]
            per, used = free // n, capacity - free
            full = min(count, todo // per)               # filled one after another
            for k in range(per if full else 0):
                place(n, full, first, used + k * n)
            leave(free - per * n, first, full)
            todo -= full * per
            count, first = count - full, first + full
            if count and todo:                            # fewer pieces left than fit in one
                for k in range(todo):
                    place(n, 1, first, used + k * n)
                leave(free - todo * n, first, 1)
                count, first, todo = count - 1, first + 1, 0
            leave(free, first, count)
    return runs


def ordered_positions(df: DataFrame, *keys: str) -> DataFrame:
    """Add ``position``, the row's place (from 0) in the order of the keys.

    Range sort, row number inside the partition, and the sizes of the
    partitions before it.  The sorted rows are written to the shared folder
    first, so both passes see the same partitions even after a lost executor.
    """
    spark = df.sparkSession
    fixed = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                        .withColumn("_at", F.monotonically_increasing_id()), "sorted")
    sizes = {r["_part"]: r["count"] for r in
             fixed.groupBy(F.expr("shiftright(_at, 33)").alias("_part")).count().collect()}
    parts = sorted(sizes)
    before = dict(zip(parts, accumulate((sizes[p] for p in parts), initial=0)))
    table = spark.createDataFrame([(p, before[p]) for p in parts], "_part long, _before long")
    return (fixed.withColumn("_part", F.expr("shiftright(_at, 33)"))
            .join(F.broadcast(table), "_part")            # one short row per shuffle partition
            .withColumn("position", F.col("_before") + (F.col("_at") % F.lit(1 << 33)))
            .drop("_part", "_before", "_at"))


def pack(parts: DataFrame, capacity: int, key_cols: tuple[str, ...] = ("doc_id", "piece"),
         length_col: str = "length") -> DataFrame:
    """Add sequence_id and offset to pieces of at most ``capacity``.

    The histogram (at most ``capacity`` rows) comes to the driver; the runs
    (bounded by the capacity, not by the corpus) go to every task.
    """
    placed = ordered_positions(parts, length_col, *key_cols)
    histogram = {r[0]: r[1] for r in placed.groupBy(length_col).count().collect()}
    runs = plan_runs(histogram, capacity)
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for n, count, first, used in runs:
        by_length.setdefault(n, []).append((count, first, used))
    flat = [r for n in sorted(by_length) for r in by_length[n]]
    starts = np.asarray(list(accumulate((r[0] for r in flat), initial=0))[:-1], np.int64)
    first = np.asarray([r[1] for r in flat], np.int64)
    used = np.asarray([r[2] for r in flat], np.int64)
    names = placed.columns
    at = names.index("position")

    def run(batches):
        for b in batches:
            pos = b.column(at).to_numpy(zero_copy_only=False)
            k = np.searchsorted(starts, pos, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(c for i, c in enumerate(b.columns) if i != at),
                 pa.array(first[k] + (pos - starts[k])), pa.array(used[k])],
                [*(c for c in names if c != "position"), "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields
                       if f.name != "position")
    return arrow_map(placed, run, f"{fields}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, pieces in offset order;
    a sequence holds at most ``capacity`` ids.  Needs pieces with ids."""
    return (packed.groupBy("sequence_id")
            .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
            .select("sequence_id", F.flatten(F.transform("_p", lambda x: x["ids"])).alias("ids")))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int,
                   spaces_matter: bool = True, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Pieces of every document with their place: id_col, piece, start,
    length, ids_crc32, sequence_id, offset.  The encoded pieces are written to
    the shared folder once, without ids; sorting and packing read that."""
    cut = materialise(pieces(docs, tokenizer_path, end_id, capacity, spaces_matter, id_col, text_col),
                      "pieces")
    return pack(cut, capacity, (id_col, "piece"))
