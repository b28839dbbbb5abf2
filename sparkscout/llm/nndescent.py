"""Approximate nearest neighbours on a neighbour graph built by NN-descent
(operator 5).

*Graph.*  Equal vectors are one node.  A first graph comes from leaves of
random projection trees (slabs of a sort by one projection, cut by a second
one, so a leaf has a fixed size whatever the data).  Each round gathers at every node its neighbours and a sample of the
nodes it is a neighbour of, compares those with each other and offers them to
one another: neighbours of neighbours.  A pair is only compared if one of the
two is new at that node, and only sent if it improves on the worst neighbour
so far.  Rounds are joins and bounded groups; the graph is written to the
shared folder after each.

*Search.*  A query starts at its own place in the graph and repeatedly expands
the nearest nodes that are not yet expanded, among the ``width`` nearest seen.
Distances are exact, in double precision on the original vectors.  All queries
advance together, one join per step.

Defined cases: vectors that are null, empty, zero or hold null, NaN or infinite
components take no part, as query or candidate; of rows that repeat an id and
vector one takes part; ties go to the smaller id; with fewer candidates than
asked for all are returned; vectors of another length than the most common
one (the shorter of equally common) take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import arrow_map, materialise, ship
from .packing import ordered_positions

#: nodes of a leaf of a projection tree, and of the slab above it
LEAF, SLAB = 512, 4096


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    v = F.col(vec_col)
    ok = (F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
          & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
          & F.exists(v, lambda x: x != 0))
    kind = vectors.schema[vec_col].dataType.elementType           # -0.0 becomes 0.0: equal vectors, one node
    rows = vectors.filter(F.coalesce(ok, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.transform(v, lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast(kind)).alias("vec"))
    size = rows.groupBy(F.size("vec").alias("s")).count().orderBy(F.desc("count"), "s").first()
    return rows.filter(F.size("vec") == (size["s"] if size else 0))


def nodes_and_members(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(node, vec), one per different vector, and (node, id): of each node the
    ``most`` smallest ids (more can't be among the nearest of one query)."""
    nodes = materialise(rows.groupBy("vec").agg(F.min("id").alias("node")).select("node", "vec"), "nodes")
    order = Window.partitionBy("vec").orderBy("id")
    ids = (rows.distinct().withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= most)
           .groupBy("vec").agg(F.collect_list("id").alias("ids")))
    members = (ids.select(F.array_min("ids").alias("node"), F.explode("ids").alias("id")))
    return nodes, materialise(members, "members")


def _compact(nodes: DataFrame, kind: type, seeds: list[int]) -> DataFrame:
    """(node, small, p0, p1, ...): the components of the vectors as bytes, as
    exact as they are given, and random projections."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy().astype(kind).reshape(b.num_rows, -1)
            cols = [b.column(0), pa.array([r.tobytes() for r in x], pa.binary())]
            wide = x.astype(np.float64)
            for s in seeds:
                cols.append(pa.array(wide @ np.random.default_rng(s).normal(size=wide.shape[1])))
            yield pa.RecordBatch.from_arrays(cols, ["node", "small", *(f"p{k}" for k in range(len(seeds)))])

    return arrow_map(nodes, run, "node bigint, small binary" + "".join(f", p{k} double" for k in range(len(seeds))))


def _vectors(col: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """A column of vectors of one component type as one matrix of doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not len(col):
        return np.zeros((0, 0))
    ends = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    return data.view(kind).reshape(len(col), -1).astype(np.float64)


#: below this share of the squared norms a distance taken from products is taken anew
CANCELS = 1e-6


def _squares(y: np.ndarray) -> np.ndarray:
    """Squared distances within each group of (groups, members, components):
    from products of centred vectors, and from differences where that would
    lose digits or overflow."""
    with np.errstate(over="ignore", invalid="ignore"):
        x = y - np.median(y, axis=1, keepdims=True)                  # one far vector moves no median
        sq = (x * x).sum(axis=2)
        both = sq[:, :, None] + sq[:, None, :]
        d = both - 2 * (x @ x.transpose(0, 2, 1))
        g, i, j = np.nonzero(~((d > CANCELS * both) & np.isfinite(d)))
        for at in range(0, len(g), 1 << 16):
            a, b, c = g[at:at + (1 << 16)], i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            d[a, b, c] = ((y[a, b] - y[a, c]) ** 2).sum(axis=1)
    return np.minimum(d, np.finfo(np.float64).max)


PAIRS = "a bigint, b bigint, d double"


def _leaf_pairs(k: int, kind: type):
    def run(t: pa.Table) -> pa.Table:
        ids, x = t.column("node").to_numpy(), _vectors(t.column("small"), kind)
        d = _squares(x[None])[0]
        np.fill_diagonal(d, np.inf)
        m = min(k, len(ids) - 1)
        best = np.argpartition(d, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(ids), 0), int)
        row = np.repeat(np.arange(len(ids)), best.shape[1])
        col = best.reshape(-1)
        return pa.table([ids[row], ids[col], d[row, col]], ["a", "b", "d"])
    return run


def _first_graph(small: DataFrame, trees: int, k: int, kind: type) -> DataFrame:
    """Pairs of leaf mates of ``trees`` projection trees."""
    out = None
    for t in range(trees):
        first, second = f"p{2 * t}", f"p{2 * t + 1}"
        slab = ordered_positions(small.select("node", "small", first, second), first, "node").withColumn(
            "slab", F.floor(F.col("position") / SLAB))
        w = Window.partitionBy("slab").orderBy(second, "node")      # a window holds one slab
        leaf = F.col("slab") * (SLAB // LEAF) + F.floor((F.row_number().over(w) - 1) / LEAF)
        pairs = (slab.select(leaf.alias("leaf"), "node", "small").groupBy("leaf")
                 .applyInArrow(_leaf_pairs(k, kind), PAIRS))
        out = pairs if out is None else out.union(pairs)
    return out


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each a, of (a, b, d, fresh) with repeats; what was
    there before stays old.  One shuffle by a serves both steps."""
    once = pairs.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("a").orderBy("d", "b")
    return once.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of rows sorted by ``key``, cut between groups.  What is held
    over is one group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        keys = b.column(key).to_numpy()
        first = int(np.searchsorted(keys, keys[-1]))                # where the last group begins
        if first:
            yield pa.Table.from_batches([*held[:-1], b.slice(0, first)])
            held = [b.slice(first)]
        elif len(held) > 1 and held[-2].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held[:-1])
            held = [b]
    if held:
        yield pa.Table.from_batches(held)


#: nodes whose gathered neighbours are compared at once, and offers a pair of a
#: node and a gathering sends at most (the graph keeps improving over the rounds)
JOIN_NODES, OFFERS = 64, 16


def _local_join(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
    """Offers among the nodes gathered at each node v; rows are sorted by
    (v, u), and u may come twice."""
    for t in whole_groups(batches, "v"):
        v, u = t.column("v").to_numpy(), t.column("u").to_numpy()
        fresh, worst = t.column("fresh").to_numpy() > 0, t.column("worst").to_numpy()
        x = _vectors(t.column("small"), kind)
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1])
        start = np.flatnonzero(new)
        fresh = np.logical_or.reduceat(fresh, start)
        v, u, worst, x = v[start], u[start], worst[start], x[start]
        head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        sizes = np.diff(np.append(head, len(v)))
        live = np.logical_or.reduceat(fresh, head) & (sizes > 1)    # nothing new here: nothing to compare
        head, sizes = head[live], sizes[live]
        for at in range(0, len(head), JOIN_NODES):
            h, n = head[at:at + JOIN_NODES], sizes[at:at + JOIN_NODES]
            m = int(n.max())
            slot = np.arange(m)[None, :] < n[:, None]
            row = np.minimum(h[:, None] + np.arange(m)[None, :], len(v) - 1)
            row = np.where(slot, row, h[:, None])                   # free slots repeat the first member
            d = _squares(x[row])
            f = fresh[row]
            good = (f[:, :, None] | f[:, None, :]) & slot[:, :, None] & slot[:, None, :]
            good &= (d < worst[row][:, :, None]) & ~np.eye(m, dtype=bool)[None]
            d[~good] = np.inf
            if m > OFFERS:
                best = np.argpartition(d, OFFERS - 1, axis=2)[:, :, :OFFERS]
                d = np.take_along_axis(d, best, axis=2)
                g, i, k = np.nonzero(np.isfinite(d))
                j = best[g, i, k]
            else:
                g, i, k = np.nonzero(np.isfinite(d))
                j = k
            yield pa.RecordBatch.from_arrays(
                [pa.array(u[row[g, i]]), pa.array(u[row[g, j]]), pa.array(d[g, i, k])],
                ["a", "b", "d"])


def neighbour_graph(nodes: DataFrame, k: int = 40, reverse: int = 32, rounds: int = 7, trees: int = 2,
                    least_change: float = 0.02, seed: int = 5) -> DataFrame:
    """(a, b, d): about the k nearest nodes b of every node a, d being the
    squared distance in double precision.  Stops when a round changes less than
    ``least_change`` of the graph."""
    ship(nodes.sparkSession)
    kind = np.float32 if nodes.schema["vec"].dataType.elementType == T.FloatType() else np.float64
    small = materialise(_compact(nodes, kind, [seed * 1000 + j for j in range(2 * trees)]), "compact")
    vectors = small.select("node", "small")
    graph = materialise(_nearest(_first_graph(small, trees, k, kind).withColumn("fresh", F.lit(1)), k), "graph")
    for _ in range(rounds):
        sample = Window.partitionBy("b").orderBy(F.desc("fresh"), F.xxhash64("a", "b"))
        back = (graph.withColumn("_k", F.row_number().over(sample)).filter(F.col("_k") <= reverse)
                .select(F.col("b").alias("v"), F.col("a").alias("u"), "fresh"))
        gathered = graph.select(F.col("a").alias("v"), F.col("b").alias("u"), "fresh").union(back)
        worst = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("worst"))
        known = vectors.join(worst, vectors["node"] == worst["a"], "left").select(
            F.col("node").alias("u"), "small", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        lists = gathered.join(known, "u").repartition("v").sortWithinPartitions("v", "u")
        offers = lists.select("v", "u", "fresh", "small", "worst").mapInArrow(
            lambda batches: _local_join(batches, kind), PAIRS)
        merged = graph.select("a", "b", "d", F.lit(0).alias("fresh")).union(
            offers.select("a", "b", "d", F.lit(1).alias("fresh")))
        graph = materialise(_nearest(merged, k), "graph")
        counts = graph.agg(F.count("*"), F.sum("fresh")).first()
        if not counts[0] or (counts[1] or 0) < least_change * counts[0]:
            break
    return graph.select("a", "b", "d")


def _exact(pairs: DataFrame) -> DataFrame:
    """(q, node, d) from (q, node, qvec, vec): Euclidean distance in doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1)
            y = b.column(3).flatten().to_numpy().astype(np.float64).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.sqrt(((x - y) ** 2).sum(axis=1)))], ["q", "node", "d"])

    return arrow_map(pairs.select("q", "node", "qvec", "vec"), run, "q bigint, node bigint, d double")


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, width: int = 100,
           steps: int = 12) -> DataFrame:
    """(q, node, d): what a greedy search from each query node q has seen,
    itself included.  ``queries`` are nodes: (q)."""
    both = graph.select("a", "b").union(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialise(both, "edges")
    start = nodes.join(queries, nodes["node"] == queries["q"], "left_semi").select(
        F.col("node").alias("q"), F.col("vec").alias("qvec"))
    start = materialise(start, "queries")
    seen = start.select("q", F.col("q").alias("node"), F.lit(0.0).alias("d"), F.lit(False).alias("done"))
    order = Window.partitionBy("q").orderBy("d", "node")
    for _ in range(steps):
        ranked = seen.withColumn("_k", F.row_number().over(order))
        front = ranked.filter((F.col("_k") <= width) & ~F.col("done")).select("q", F.col("node").alias("a"))
        new = (front.join(edges, "a").select("q", F.col("b").alias("node")).distinct()
               .join(seen.select("q", "node"), ["q", "node"], "left_anti"))
        found = _exact(new.join(nodes, "node").join(start, "q")).withColumn("done", F.lit(False))
        marked = ranked.select("q", "node", "d", (F.col("done") | (F.col("_k") <= width)).alias("done"))
        seen = materialise(marked.union(found), "seen")
        ranked = seen.withColumn("_k", F.row_number().over(order))
        if ranked.filter((F.col("_k") <= width) & ~F.col("done")).isEmpty():
            break
    return seen.select("q", "node", "d")


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            graph_k: int = 40, width: int = 100) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest rows found for every row
    where ``is_query`` (a condition on ``id``) holds, nearest first."""
    rows = usable(vectors, id_col, vec_col)
    nodes, members = nodes_and_members(rows, k + 1)
    graph = neighbour_graph(nodes, graph_k)
    asked = rows.filter(is_query).distinct().join(nodes, "vec").select("id", F.col("node").alias("q"))
    asked = materialise(asked, "asked")
    seen = search(asked.select("q").distinct(), nodes, graph, width)
    best = Window.partitionBy("q").orderBy("d", "node")
    close = seen.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= k + 1).drop("_k")
    found = (close.join(members, "node").select("q", F.col("id").alias("_vec"), "d")
             .join(asked.withColumnRenamed("id", "query_id"), "q").filter("_vec <> query_id"))
    order = Window.partitionBy("query_id").orderBy("d", "_vec")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("_vec").alias(id_col), F.col("d").alias("score")))
