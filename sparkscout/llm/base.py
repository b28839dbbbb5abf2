"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, register, stored

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application
    (``addPyFile``), so that Python tasks can import it wherever they run.
    The driver's file server hands the archive out; no executor reads the
    folder that it is packed in."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkscout_shipped", False):
        return
    top = os.path.dirname(PACKAGE_ROOT)
    path = os.path.join(tempfile.mkdtemp(prefix="sparkscout-pkg-"), "sparkscout_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(PACKAGE_ROOT):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    sc._sparkscout_shipped = True


_CACHES: dict[str, Callable[[], None]] = {}


def take_over(owner: str, clear: Callable[[], None]) -> None:
    """Called by an operator that keeps a cache in its Python worker: the
    caches that other operators left in this process are dropped first, and
    their memory goes back to the system."""
    others = [o for o in _CACHES if o != owner]
    for other in others:
        _CACHES.pop(other)()
    _CACHES[owner] = clear
    if others:
        _give_back()


def _give_back() -> None:
    """Free memory of this process to the system; the C library keeps most of
    what small objects leave behind, until it is told."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):                    # no such call outside glibc
        pass


#: bytes of texts that a task turns into Python objects at once
SLICE_BYTES = 1 << 22


def slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most ``SLICE_BYTES`` in column ``at``;
    a longer text has one of its own.  What the task freed goes back to the
    system at its end: its worker may wait through the next stages."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(ends):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi
    _give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, unchanged."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


#: rows of an Arrow batch; both ends of the pipe to a Python worker hold a whole batch of texts
BATCH_ROWS = 2_500
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped first.  The session's Arrow
    batches are held to ``BATCH_ROWS`` rows; a smaller setting stays."""
    ship(df.sparkSession)
    if not 0 < int(df.sparkSession.conf.get(_BATCH_SETTING)) <= BATCH_ROWS:
        df.sparkSession.conf.set(_BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def crc_mod(key: str | Column, mod: int) -> Column:
    """crc32 of a key's decimal text, modulo ``mod`` (null key: null)."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(c.cast("string").cast("binary")) % mod


def hash_share(key: Column, share: Column | float) -> Column:
    """Whether a key's hash falls into the first ``share`` of all hashes."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < share * F.lit(float(1 << 40))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened until none is a name of ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w += "_"
        taken.add(w.lower())
        out.append(w)
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    return register(f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts the lineage
    and survives lost executors, with columnar files in place of a row
    checkpoint."""
    return stored(df, name)
