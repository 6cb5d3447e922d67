"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014) as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, fresh_path


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges a, b of one integer type: node, root (the least node of its component), for all nodes with an edge.

    Each step is written to the shared folder; edges only ever meet the least neighbour of a node, so a node with very
    many edges costs no more than its rows.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before, seen = None, None
    for _ in range(rounds):
        path = fresh_path(spark, "components")
        _small(_large(now)).write.parquet(path)
        now = spark.read.parquet(path)
        # a fixed point: each node has one edge, to its root, and no root has an edge to a smaller node
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before:
            drop_path(spark, before)
        before = path
        if tuple(sums) == seen:
            break
        seen = tuple(sums)
    else:
        raise RuntimeError("components have not settled")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _large(edges: DataFrame) -> DataFrame:
    """Of each node's neighbourhood, the larger nodes get an edge to the least."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Of each node's smaller neighbours and itself, all get an edge to the least."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
