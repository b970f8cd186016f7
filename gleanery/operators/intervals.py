"""Joins of ranges and places whose rows grow with their inputs, not with the pairs that meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _levels(top: Column) -> Column:
    """0 to the highest binary digit of a whole number from 1."""
    return F.sequence(F.lit(0), F.floor(F.log2(top.cast("double") + 0.5)).cast("int"))


def _block(level: Column, at: Column) -> Column:
    return F.struct(level.alias("level"), at.cast("long").alias("at"))


def containing(place: Column) -> Column:
    """The binary blocks (level, at) that contain a place from 1: at each level one of 2^level places. Blocks from 0 on are left out, as no range begins there."""
    return F.transform(_levels(place), lambda k: _block(k, _shifted(place, k)))


def _shifted(x: Column, k: Column) -> Column:
    return F.floor(x.cast("long") / F.pow(F.lit(2.0), k)).cast("long")


def covering(low: Column, high: Column) -> Column:
    """The binary blocks that make up the range low to high, from 1, two of a level at most; none if high is below low."""
    size = lambda k: F.pow(F.lit(2.0), k).cast("long")

    def of_level(k: Column) -> Column:
        first, end = _shifted(low.cast("long") + size(k) - 1, k), _shifted(high.cast("long") + 1, k)
        left = F.when((first < end) & (first % 2 == 1), _block(k, first))
        right = F.when((first < end) & (end % 2 == 1), _block(k, end - 1))
        return F.array_compact(F.array(left, right))

    return F.when(low <= high, F.flatten(F.transform(_levels(F.greatest(high, F.lit(1))), of_level)))


def nearest_and_inside(ranges: DataFrame, places: DataFrame, keys: list[str], place: str) -> DataFrame:
    """ranges (hit_id, keys, a, b) with what places (keys, place; distinct) of the same keys have: how many lie in a..b (inside), the last one before a and the first one after b.

    Both tables are put in one order by key, a range as its two ends, and read once from either side: a count so far, the last place so far and
    the next one. Rows are the places and twice the ranges.
    """
    none = F.lit(None).cast("long")
    events = places.select(*keys, F.col(place).alias("at"), F.lit(1).alias("kind"), F.col(place).alias("place"), F.lit(None).cast(ranges.schema["hit_id"].dataType).alias("hit_id"))
    ends = ranges.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("b").alias("at"), F.lit(2).alias("kind")))).alias("x"), "hit_id").select(*keys, "x.at", "x.kind", none.alias("place"), "hit_id")
    rows = events.unionByName(ends)
    so_far = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    from_end = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    read = rows.withColumns({"n": F.count("place").over(so_far), "last": F.max("place").over(so_far)}).withColumn("next", F.min("place").over(from_end))
    first, final = F.col("kind") == 0, F.col("kind") == 2
    found = read.where("hit_id is not null").groupBy("hit_id").agg(
        (F.max(F.when(final, F.col("n"))) - F.max(F.when(first, F.col("n")))).alias("inside"), F.max(F.when(first, F.col("last"))).alias("before"), F.max(F.when(final, F.col("next"))).alias("after")
    )
    return ranges.join(found, "hit_id")
