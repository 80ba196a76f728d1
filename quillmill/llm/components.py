"""Connected components of a graph that is only ever a distributed table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import checkpoint


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    `edges` has long columns a and b. Alternating large-star and small-star rounds; each keeps about as
    many edges as there are nodes, and every step is an aggregate (combined before the shuffle) and an
    equi-join that adaptive execution can split where a node has very many edges.
    """
    star = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(most_rounds):
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("a"), F.col("b"), F.col("m"))
        pairs = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        star = checkpoint(small.select(F.inline(pairs)).where("a <> b").distinct())
        state = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components: no fixed point")
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
