"""Elementary cycles of a directed graph that is a table of edges: bundling rules that lead back to themselves.

Nodes without an edge in or out can't be on a cycle: they are peeled off in rounds until none is left. Of the
rest, paths grow by one edge a round, from each cycle's smallest node and over larger nodes alone, so that a
cycle is found once and in its canonical rotation. Each round is an equi-join of paths with edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.sources.shared import stored


def core(edges: DataFrame) -> DataFrame:
    """The distinct edges (a, b) that are left once nodes without an edge in or out are peeled off."""
    left = stored(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    n = left.count()
    while n:
        both = left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        left = stored(both.select("a", "b"))
        last, n = n, left.count()
        if n == last:
            break
    return left


def cycles(edges: DataFrame, most_length: int | None = None) -> DataFrame:
    """cycle (array of nodes from the smallest) of all elementary cycles, or of those of up to `most_length` nodes; null nodes have no edges.

    Cycles can be as many as there are subsets of nodes: bound the length where the graph is dense.
    """
    left = core(edges)
    loops = left.where("a = b").select(F.array("a").alias("cycle"))
    step = left.where("a <> b").select(F.col("a").alias("_from"), F.col("b").alias("_to"))
    paths = step.where("_from < _to").select(F.array("_from", "_to").alias("cycle"), F.col("_to").alias("last"))
    out, size = [loops], 2
    while most_length is None or size <= most_length:
        paths = stored(paths)
        if paths.isEmpty():
            break
        on = paths.join(step, F.col("last") == F.col("_from"))
        out.append(on.where(F.col("_to") == F.col("cycle")[0]).select("cycle"))
        paths = on.where((F.col("_to") > F.col("cycle")[0]) & ~F.array_contains("cycle", F.col("_to"))).select(F.concat("cycle", F.array("_to")).alias("cycle"), F.col("_to").alias("last"))
        size += 1
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole
