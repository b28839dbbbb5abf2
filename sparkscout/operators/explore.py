"""Aggregates behind the exploration charts.

Only the data is built; drawing is left to the caller.  Every function
returns a small aggregated DataFrame except ``line_sorted`` (a range-sorted
table), ``scatter`` and ``scatter_matrix`` (projections of every row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import numeric_cols
from ..session import checkpoint, stored
from .quantiles import exact_quantiles


def headline(df: DataFrame, insights: DataFrame | None = None) -> DataFrame:
    """Rows, columns, numeric columns and (optionally) insight count."""
    n_ins = insights.count() if insights is not None else None
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"),
        F.lit(len(numeric_cols(df))).cast("long").alias("n_numeric"),
        F.lit(n_ins).cast("long").alias("n_insights"))


def scatter(df: DataFrame, x: str, y: str, color: str | None = None, hover: list[str] | None = None) -> DataFrame:
    """E5: ``x, y[, color][, hover...]`` of every row."""
    return df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([x, y, *([color] if color else []), *(hover or [])])])


def scatter_matrix(df: DataFrame, cols: list[str] | None = None, first: int = 4) -> DataFrame:
    """E5: the first ``first`` numeric columns of every row, for a matrix of
    scatter plots."""
    return df.select(*[F.col(f"`{c}`") for c in (cols if cols is not None else numeric_cols(df)[:first])])


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 100) -> DataFrame:
    """E5 for tables too large to draw: exact counts on a ``bins`` by ``bins``
    grid over the range of both columns: ``(bin_x, bin_y, count)``."""
    vx, vy = F.col(f"`{x}`").cast("double"), F.col(f"`{y}`").cast("double")
    base = df.select(vx.alias("x"), vy.alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    r = base.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if r["x0"] is None:
        return df.sparkSession.createDataFrame([], "bin_x int, bin_y int, count long")

    def cell(v, lo, hi):
        width = (hi - lo) / bins if hi > lo else 1.0
        return F.least(F.floor((v - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins)).cast("int")

    return base.groupBy(cell(F.col("x"), r["x0"], r["x1"]).alias("bin_x"),
                        cell(F.col("y"), r["y0"], r["y1"]).alias("bin_y")).agg(F.count(F.lit(1)).alias("count"))


def line_sorted(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """``x, y[, color]`` ordered by ``x`` (a distributed range sort)."""
    cols = [x, y] + ([color] if color and color not in (x, y) else [])
    return df.select(*[F.col(f"`{c}`") for c in cols]).orderBy(F.col(f"`{x}`").asc_nulls_last())


def bar_means(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Mean of ``y`` per ``x`` (and ``color``); rows with a null key are
    dropped, null values ignored; ``color == x`` collapses to one key."""
    keys = [x] + ([color] if color and color != x else [])
    base = df
    for k in keys:
        base = base.filter(F.col(f"`{k}`").isNotNull())
    return base.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.avg(F.col(f"`{y}`")).alias("mean_value"))


def histogram(df: DataFrame, x: str, bins: int = 30, color: str | None = None) -> DataFrame:
    """``bins`` equal-width bins over [min, max] (max falls in the last
    bin): ``(bin, lo, hi, [color,] count)``."""
    v = F.col(f"`{x}`").cast("double")
    rng = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    lo, hi = rng["lo"], rng["hi"]
    keys = [color] if color else []
    if lo is None:
        return df.sparkSession.createDataFrame(
            [], "bin int, lo double, hi double, count long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((v - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins)).cast("int")
    base = df.filter(v.isNotNull())
    g = base.groupBy(b.alias("bin"), *[F.col(f"`{k}`") for k in keys]).agg(
        F.count(F.lit(1)).alias("count"))
    return g.select("bin", (F.lit(lo) + (F.col("bin") - 1) * width).alias("lo"),
                    (F.lit(lo) + F.col("bin") * width).alias("hi"),
                    *[F.col(f"`{k}`") for k in keys], "count")


def _box_base(df: DataFrame, y: str, group: str | None, color: str | None) -> tuple[DataFrame, list[str]]:
    keys = {"category": F.col(f"`{group}`").cast("string") if group else F.lit("all")}
    if color and color != group:
        keys["color"] = F.col(f"`{color}`").cast("string")
    base = df.select(*[c.alias(k) for k, c in keys.items()], F.col(f"`{y}`").cast("double").alias("value"))
    for k in [*keys, "value"]:
        base = base.filter(F.col(k).isNotNull())
    return base, list(keys)


def box_fences(df: DataFrame, y: str, group: str | None = None, whisker: float = 1.5,
               color: str | None = None, **quantile_kw) -> DataFrame:
    """Exact quartiles and 1.5 IQR fences per group (and colour):
    ``(category[, color], n, q1, median, q3, lower_fence, upper_fence)``."""
    base, keys = _box_base(df, y, group, color)
    qs = exact_quantiles(base, keys, "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"], **quantile_kw)
    iqr = F.col("q3") - F.col("q1")
    return qs.select(*keys, "n", "q1", "median", "q3", (F.col("q1") - whisker * iqr).alias("lower_fence"),
                     (F.col("q3") + whisker * iqr).alias("upper_fence"))


def box_stats(df: DataFrame, y: str, group: str | None = None, whisker: float = 1.5,
              color: str | None = None, **quantile_kw) -> DataFrame:
    """:func:`box_fences` plus whiskers (extreme values inside the fences)
    and outlier counts per group (rows with a null group are left out):
    ``(..., whisker_low, whisker_high, n_outliers)``."""
    base, keys = _box_base(df, y, group, color)
    fences = checkpoint(box_fences(df, y, group, whisker, color, **quantile_kw))
    # one row per group; the planner broadcasts it when small
    j = base.join(fences.select(*keys, "lower_fence", "upper_fence"), keys)
    inside = F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    agg = j.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))
    return fences.join(agg, keys)


def box_outliers(df: DataFrame, y: str, group: str | None = None, whisker: float = 1.5,
                 color: str | None = None, **quantile_kw) -> DataFrame:
    """E9 points: the rows outside the fences ``(category[, color], value)``."""
    base, keys = _box_base(df, y, group, color)
    fences = box_fences(df, y, group, whisker, color, **quantile_kw).select(*keys, "lower_fence", "upper_fence")
    return base.join(fences, keys).filter(
        ~F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))).select(*keys, "value")


def pie_shares(df: DataFrame, names: str, values: str, top: int = 10,
               other: str = "Other") -> DataFrame:
    """Sum of ``values`` per ``names`` (all-null sums count as 0); with
    more than ``top`` groups, the ``top`` largest (ties: name asc) plus one
    ``Other`` row with the rest.  ``(name, total, slice_rank)``; slices are
    ranked by total desc, name asc, ``Other`` last."""
    sums = df.filter(F.col(f"`{names}`").isNotNull()).groupBy(
        F.col(f"`{names}`").cast("string").alias("name")).agg(
        F.coalesce(F.sum(F.col(f"`{values}`")), F.lit(0)).alias("total"))
    # the aggregate runs once; ranking and the rest read its written result
    sums = stored(sums, "shares")
    order = [F.col("total").desc(), F.col("name").asc()]
    head = sums.orderBy(*order).limit(top)                       # distributed top-k, then at most `top` rows
    head = head.withColumn("slice_rank", F.row_number().over(Window.orderBy(*order)))
    rest = (sums.join(F.broadcast(head.select("name")), "name", "left_anti")
            .agg(F.sum("total").alias("total"), F.count(F.lit(1)).alias("_n")).filter("_n > 0")
            .select(F.lit(other).alias("name"), F.col("total").cast(sums.schema["total"].dataType),
                    F.lit(top + 1).alias("slice_rank")))
    return head.unionByName(rest)
