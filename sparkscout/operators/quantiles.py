"""Exact quantiles (linear interpolation, as pandas/DuckDB ``quantile_cont``)
without pulling a whole group into one task.

``percentile`` keeps a value->count map per group and merges it in one task,
which is unbounded for a continuous column over a large table.  Here one path
serves every size:

1. one scan: the count of each group and ``splits`` quantile sketch points
   (``percentile_approx``, bounded memory).  The points next to a wanted rank
   bracket it for certain, because the sketch is ten times finer than them;
2. while a bracket may hold more than ``max_bracket_rows`` rows, its own sketch
   points narrow it by a further scan.  Only values strictly inside count, so
   each round leaves fewer of them, however often the ends repeat;
3. one scan counts the rows below each bracket, a number a bracket and task,
   and one the different values inside it; the wanted rank is found in their
   running sum.

Infinite values are ordinary ordered values; no step does arithmetic on
bounds.  The state (a few rows per group) is written to the shared folder.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

MAX_BRACKET_ROWS = 1 << 20
SPLITS = 1000
#: groups up to which their brackets are sent to every task
BROADCAST_GROUPS = 50_000


def _prob_name(p: float) -> str:
    return "q" + f"{p:g}".replace(".", "_").replace("-", "m")


def _sketch(splits: int):
    return F.percentile_approx("_v", [i / splits for i in range(splits + 1)], 10 * splits)


def exact_quantiles(long_df: DataFrame, keys: list[str], value: str, probs: list[float],
                    names: list[str] | None = None, max_bracket_rows: int = MAX_BRACKET_ROWS,
                    splits: int = SPLITS, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Quantiles of ``value`` per ``keys`` group.

    Returns ``keys + [n] + names`` (one column per probability, DOUBLE).
    Nulls and NaN are ignored; an all-null group is absent.
    ``approx=True`` switches to ``percentile_approx`` (one pass, bounded
    memory, returns an element instead of the interpolated value).
    """
    names = names or [_prob_name(p) for p in probs]
    keys = list(keys)
    base = (long_df.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias("_v"))
            .filter(F.col("_v").isNotNull() & ~F.isnan("_v")))
    if approx:
        pa = F.percentile_approx("_v", [float(p) for p in probs], accuracy)
        agg = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pa.alias("_qs"))
        return agg.select(*keys, "n", *[F.col("_qs")[i].alias(nm) for i, nm in enumerate(names)])

    sketch = stored(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _sketch(splits).alias("_s")))
    plist = F.array(*[F.lit(float(p)) for p in probs])
    wanted = (sketch.select(*keys, "n", F.posexplode(plist).alias("_qi", "_p"))
              .withColumn("_pos", (F.col("n") - 1) * F.col("_p"))
              .withColumn("_rlo", F.floor("_pos").cast("long"))
              .withColumn("_rhi", F.ceil("_pos").cast("long"))
              .withColumn("_frac", F.col("_pos") - F.col("_rlo")))
    # a target is one wanted rank; it lies between the sketch points _lo and _hi
    targets = (wanted.select(*keys, F.explode(F.array("_rlo", "_rhi")).alias("_rank")).distinct()
               .join(sketch, keys))
    targets = stored(_bracket(targets, F.lit(0).cast("long"), F.col("n"), splits).select(
        *keys, "_rank", "_lo", "_hi", F.ceil(3 * F.col("n") / splits).alias("_most")))
    while True:
        wide = targets.filter((F.col("_most") > max_bracket_rows) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
        inner = (v > lo) & (v < hi)
        found = stored(_located(base, wide, keys).groupBy(*keys, "_rank", "_lo", "_hi").agg(
            F.count_if(v <= lo).alias("_below"), F.count_if(inner).alias("_in"),
            F.percentile_approx(F.when(inner, v), [i / splits for i in range(splits + 1)], 10 * splits).alias("_s")))
        # the rank is an end of the bracket or strictly inside; only the latter goes on
        rank, below, count = F.col("_rank"), F.col("_below"), F.col("_in")
        narrowed = _bracket(found.withColumnsRenamed({"_lo": "_lo0", "_hi": "_hi0"}), below, F.greatest(count, F.lit(1)),
                            splits)
        at_lo, at_hi = rank < below, rank >= below + count
        narrowed = narrowed.select(
            *keys, "_rank", F.when(at_lo, F.col("_lo0")).when(at_hi, F.col("_hi0")).otherwise(F.col("_lo")).alias("_lo"),
            F.when(at_lo, F.col("_lo0")).when(at_hi, F.col("_hi0")).otherwise(F.col("_hi")).alias("_hi"),
            F.least(F.ceil(3 * count / splits), count - 1).alias("_most"))
        rest = targets.join(wide.select(*keys, "_rank"), [*keys, "_rank"], "left_anti")
        targets = stored(rest.unionByName(narrowed.select(rest.columns)))

    # rows below each bracket are counted beside each other, one number a bracket
    lists, most = _lists(targets, keys)
    beside = base.join(lists, keys)
    v = F.col("_v")
    sums = F.array(*[F.col(f"_b{k}") for k in range(most)])
    below = (beside.groupBy(*keys).agg(*[F.sum((v < F.get("_t", F.lit(k))["_lo"]).cast("long")).alias(f"_b{k}")
                                         for k in range(most)])
             .join(lists, keys).select(*keys, F.explode(F.transform("_t", lambda t, k: F.struct(
                 t["_rank"].alias("_rank"), F.get(sums, k).alias("_below")))).alias("_h"))
             .select(*keys, "_h._rank", "_h._below"))
    close = reduce(or_, [(v >= t["_lo"]) & (v <= t["_hi"]) for t in (F.get("_t", F.lit(k)) for k in range(most))])
    # the rows of a value are counted before it is copied to its brackets: a column of
    # few values has most of its rows in them
    per_value = beside.filter(close).groupBy(*keys, v.alias("_val")).agg(F.count(F.lit(1)).alias("_c"))
    inside = F.filter("_t", lambda t: (F.col("_val") >= t["_lo"]) & (F.col("_val") <= t["_hi"]))
    seen = per_value.join(lists, keys).select(*keys, F.explode(F.transform(inside, lambda t: t["_rank"])).alias("_rank"),
                                              "_val", "_c")
    w = Window.partitionBy(*keys, "_rank").orderBy("_val").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = (seen.join(below, [*keys, "_rank"]).withColumn("_cum", F.col("_below") + F.sum("_c").over(w))
              .filter((F.col("_cum") > F.col("_rank")) & (F.col("_cum") - F.col("_c") <= F.col("_rank")))
              .select(*keys, "_rank", "_val"))
    lo_v = values.select(*keys, F.col("_rank").alias("_rlo"), F.col("_val").alias("_vlo"))
    hi_v = values.select(*keys, F.col("_rank").alias("_rhi"), F.col("_val").alias("_vhi"))
    between = F.when(F.col("_vlo") == F.col("_vhi"), F.col("_vlo")).otherwise(
        F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac"))
    interp = (wanted.join(lo_v, keys + ["_rlo"]).join(hi_v, keys + ["_rhi"]).withColumn("_q", between))
    return interp.groupBy(*keys).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("_qi") == i, F.col("_q"))).alias(nm) for i, nm in enumerate(names)])


def _bracket(targets: DataFrame, below, count, splits: int) -> DataFrame:
    """Add _lo and _hi: sketch points one before and two after the share of
    the rank among the ``count`` sketched rows."""
    at = F.floor((F.col("_rank") - below) * F.lit(splits) / count).cast("int")
    return (targets.withColumn("_lo", F.get("_s", F.greatest(at - 1, F.lit(0))))
            .withColumn("_hi", F.get("_s", F.least(at + 2, F.lit(splits)))))


def _lists(targets: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """(keys, _t): the brackets of each group in one list, and the longest
    list's length; sent to all tasks where the groups are few."""
    lists = stored(targets.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_rank", "_lo", "_hi"))).alias("_t")),
                   "brackets")
    row = lists.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_t")).alias("most")).first()
    return (F.broadcast(lists) if row["n"] <= BROADCAST_GROUPS else lists), row["most"] or 1


def _located(base: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the base for each target whose upper end they do not exceed:
    (keys, _v, _rank, _lo, _hi)."""
    hit = F.filter("_t", lambda t: F.col("_v") <= t["_hi"])
    return base.join(_lists(targets, keys)[0], keys).select(*keys, "_v", F.explode(hit).alias("_h")).select(
        *keys, "_v", "_h._rank", "_h._lo", "_h._hi")


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                     names: list[str] | None = None, **kw) -> DataFrame:
    """Quantiles of each column in ``cols``: rows ``(column, n, q...)``."""
    from ..schema import to_long
    return exact_quantiles(to_long(df, cols), ["column"], "value", probs, names, **kw)
