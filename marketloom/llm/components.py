"""Connected components of a link table by repeated star contraction, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.scratch import drop, put


def components(links: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b longs); component is the smallest node reachable.

    Each round points neighbours of a node to its smallest neighbour, first towards larger and then towards smaller nodes, until every
    node points at the root of its component. The number of rounds follows the logarithm of the longest chain. Every round is a table in
    the shared folder. Loops (a = b) count as a node without links; null ends are ignored.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null")
    spark = links.sparkSession
    # Written once: whatever made the links does not run again for their loops.
    told, folder = put(edges.distinct(), label)
    loops, loops_at = put(told.where("a = b"), f"{label}-loops")
    state = told.where("a <> b")
    last = None
    for _ in range(rounds):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Larger neighbours of each node hang on the smallest one around it.
        wide = both.where("b > a").join(low, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        wide = wide.where("x <> y").distinct()
        # Each node and its smaller neighbours hang on the smallest of them.
        least = wide.groupBy("x").agg(F.min("y").alias("m"))
        narrow = wide.join(least, "x").select("y", "m").where("y <> m").unionByName(least.select(F.col("x").alias("y"), "m"))
        fresh, after = put(narrow.select(F.col("m").alias("a"), F.col("y").alias("b")).distinct(), label)
        sign = fresh.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).cast("string")).first()
        drop(spark, folder)
        state, folder = fresh, after
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError("components did not settle")
    nodes = state.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = state.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    if loops.isEmpty():
        drop(spark, loops_at)
        return nodes.unionByName(roots)
    return nodes.unionByName(roots).unionByName(alone.join(nodes, "node", "left_anti").join(roots, "node", "left_anti"))
