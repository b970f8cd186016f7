"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import delete, kept


def connected_components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node id (long) that can be reached.

    Each round hangs every neighbour under the smallest one it can see, first the larger neighbours, then the smaller ones;
    O(log^2 n) rounds at most, a few in practice. A round costs two aggregations with partial sums and two equi-joins whose
    one side is unique on the key. That side is a written table: both sides of the join are then plain exchanges, so that
    Spark splits the partition of a node with very many edges (skew join), or sends the small side to all. What a
    round wrote is deleted after the next one; only a row count and a hash sum reach the driver. Loops and repeated
    edges are allowed; without edges the result is empty.
    """
    spark = edges.sparkSession
    now, path = kept(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), f"{name}-0")
    sign, round_ = None, 0
    while (new := _signature(now)) != sign:
        sign, round_ = new, round_ + 1
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low, low_path = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low")
        large, large_path = kept(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        least, least_path = kept(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last = path
        now, path = kept(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{round_}")
        delete(spark, last, low_path, large_path, least_path)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
