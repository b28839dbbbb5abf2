"""Connected components by contraction, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialise


def _point_down(edges: DataFrame) -> DataFrame:
    """(v, to): each vertex and the least of itself and its neighbours."""
    return (edges.select("a", "b").union(edges.select("b", "a")).toDF("v", "w")
            .groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("to")))


def _follow(links: DataFrame) -> DataFrame:
    """One pointer jump: v goes where its target goes."""
    onward = links.select(F.col("v").alias("_at"), F.col("to").alias("_next"))
    return (links.join(onward, links["to"] == onward["_at"], "left")
            .select("v", F.coalesce("_next", "to").alias("to")))


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of an undirected edge list (a, b), root
    being the least vertex of its component.

    Each round points every vertex to its least neighbour, jumps once, maps
    the edges to the targets and drops loops and repeats, until no edge is
    left; the rounds' links are then applied one after another.  A vertex
    with very many edges is one group of an algebraic minimum, combined before
    the shuffle.  Links and edges of a round are written to the shared folder.
    """
    rest = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"),
                                                     F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps: list[DataFrame] = []
    while not rest.isEmpty():
        links = materialise(_follow(_point_down(rest)), "links")
        steps.append(links)
        left = links.select(F.col("v").alias("a"), F.col("to").alias("_a"))
        right = links.select(F.col("v").alias("b"), F.col("to").alias("_b"))
        rest = materialise(rest.join(left, "a").join(right, "b").filter("_a <> _b")
                           .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
                           .distinct(), "edges")
    if not steps:
        return rest.select(F.col("a").alias("v"), F.col("b").alias("root"))
    out = steps[0].select("v", F.col("to").alias("root"))
    for links in steps[1:]:
        onward = links.select(F.col("v").alias("_at"), F.col("to").alias("_next"))
        out = (out.join(onward, out["root"] == onward["_at"], "left")
               .select("v", F.coalesce("_next", "root").alias("root")))
    return out
