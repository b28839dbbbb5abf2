"""Sums over all pairs of columns in one pass.

Every task turns its Arrow batches into numpy matrices and adds up, for all
pairs at once, the number of rows where both columns have a value and the
sums, squares and products over those rows.  A task sends one short row per
pair; Spark adds them up.  The plan has the same size for any number of
columns, and columns with and without nulls take the same path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
SCHEMA = "lag int, i int, j int, " + ", ".join(f"{s} double" for s in SUMS)


def column_means(df: DataFrame, cols: list[str]) -> list[float]:
    """Mean of each column (0 for one without finite values), by which sums
    are centred."""
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    finite = [F.when(F.abs(v) < float("inf"), v) for v in x]
    row = df.agg(*[F.avg(v).alias(f"m{k}") for k, v in enumerate(finite)]).first()
    return [row[f"m{k}"] or 0.0 for k in range(len(cols))]


def _products(k: int):
    """(sums over the rows of a matrix with NaN for missing values, record of
    all pairs i <= j): functions of a task, without names of this module, so
    that executors need not have it."""
    def products(x):
        known = ~np.isnan(x)
        x = np.where(known, x, 0.0)
        m = known.astype(float)
        return np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])

    def result(total):
        i, j = np.triu_indices(k)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(i), np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
             *(pa.array(t[i, j]) for t in total)], ["lag", "i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])
    return products, result


#: up to this many columns the sums are column aggregates, which start faster
PLAIN_COLUMNS = 6


def _plain_sums(df: DataFrame, cols: list[str], means: list[float]) -> DataFrame:
    """The sums of a few columns as one JVM aggregate."""
    x = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) - float(m) for c, m in zip(cols, means)]
    rows = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]

    def sums(i, j):
        a, b = F.col(f"x{i}"), F.col(f"x{j}")
        both = a.isNotNull() & b.isNotNull()
        parts = (F.lit(1.0), a, b, a * a, b * b, a * b)
        return [F.coalesce(F.sum(F.when(both, p)), F.lit(0.0)).alias(f"{s}_{i}_{j}") for s, p in zip(SUMS, parts)]
    row = rows.agg(*[c for i, j in pairs for c in sums(i, j)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(0).alias("lag"), F.lit(i).alias("i"), F.lit(j).alias("j"), *[
        F.col(f"{s}_{i}_{j}").alias(s) for s in SUMS]) for i, j in pairs])).alias("p")).select("p.*")


def pair_sums(df: DataFrame, cols: list[str], means: list[float]) -> DataFrame:
    """(lag 0, i, j, sums) for all column pairs i <= j."""
    k = len(cols)
    if k <= PLAIN_COLUMNS:
        return _plain_sums(df, cols, means)
    products, result = _products(k)

    def run(batches):
        total = np.zeros((6, k, k))
        for b in batches:
            total += products(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - np.asarray(means))
        yield result(total)

    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{n}") for n, c in enumerate(cols)]) \
        .mapInArrow(run, SCHEMA)


def pair_sums_of_cells(cells: DataFrame, k: int) -> DataFrame:
    """The same sums of (row, e, x): values x of the columns e < k, one record a
    value.  The records of a row are brought together first."""
    products, result = _products(k)

    def run(batches):
        total, held = np.zeros((6, k, k)), None
        for b in batches:
            some = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                some = [np.concatenate(p) for p in zip(held, some)]
            row, e, x = some
            if not len(row):
                continue
            cut = int(np.searchsorted(row, row[-1]))               # the last row may go on
            held = [p[cut:] for p in some]
            if cut:
                _, at = np.unique(row[:cut], return_inverse=True)
                for lo in range(0, at[-1] + 1, 8192):
                    a, z = np.searchsorted(at, [lo, lo + 8192])
                    m = np.full((min(8192, at[-1] + 1 - lo), k), np.nan)
                    m[at[a:z] - lo, e[a:z]] = x[a:z]
                    total += products(m)
        if held is not None and len(held[0]):
            m = np.full((1, k), np.nan)
            m[0, held[1]] = held[2]
            total += products(m)
        yield result(total)

    near = cells.select("row", "e", "x").repartition("row").sortWithinPartitions("row")
    return near.mapInArrow(run, SCHEMA)


def add_up(sums: DataFrame) -> DataFrame:
    """One row per (lag, i, j) with Pearson's r; NULL when a side does not vary."""
    g = sums.groupBy("lag", "i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])
    n, sx, sy, sxx, syy, sxy = (F.col(s) for s in SUMS)
    vx, vy = sxx - F.try_divide(sx * sx, n), syy - F.try_divide(sy * sy, n)
    # what is left of rounding when a column does not vary counts as no variance
    flat = (vx <= 1e-12 * sxx) | (vy <= 1e-12 * syy)
    r = F.try_divide(sxy - F.try_divide(sx * sy, n), F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(~flat, r)))
    return g.select("lag", "i", "j", n.cast("long").alias("n"), F.when(~flat & r.isNotNull() & ~F.isnan(r), r).alias("r"))
