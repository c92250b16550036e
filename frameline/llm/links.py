"""Connected components of link tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameline.llm.common import written


def component_roots(edges: DataFrame, label: str = "links") -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: root is the smallest node reachable, nodes that are their own root are left out.

    Each round is joins and aggregations over the links, written to the shared folder; the number of rounds grows with
    the logarithm of a component's length. Links with a null end or both ends equal say nothing. No links give no rows.
    """
    down = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, before = written(down, label), None
    while True:
        now = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before or now["n"] == 0:
            return state.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        before = now
        both = state.union(state.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        state = written(small.union(low.select("a", "m")).distinct(), label)
