"""Connected components of a graph given as edges, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import workspace, written


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Edges (a, b) to rows (node, component), component being the smallest node of the component.

    Nodes without edges aren't returned. Null ends, loops and repeated edges are ignored; no edges give no rows.
    Each round is written to the shared folder, so lineage stays short and lost executors cost one round.
    """
    spark, home = edges.sparkSession, workspace(edges.sparkSession)
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    pairs = written(pairs, f"{home}/round0")
    last = None
    for k in range(1, max_rounds + 1):
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours go to the least one around
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        # small star: smaller neighbours and the node itself go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        pairs = written(small, f"{home}/round{k}")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        pairs.select("b", "b").distinct().toDF("node", "component")
    )
