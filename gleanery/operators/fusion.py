"""Reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT = 60


def fuse(first: DataFrame, second: DataFrame, top_k: int, k: int = RANK_CONSTANT) -> DataFrame:
    """(query_id, path, start_line, end_line, snippet, score, matched_terms, rank) from two ranked lists with those columns.

    A place scores 1/(k+rank) in each list that has it. The fields come from the first list where it has the place; terms are
    united. One shuffle by query and place instead of an outer join.
    """
    columns = ["query_id", "path", "start_line", "end_line", "snippet", "matched_terms", "rank"]
    both = first.select(*columns, F.lit(0).alias("list")).unionByName(second.select(*columns, F.lit(1).alias("list")))
    place = ["query_id", "path", "start_line", "end_line"]
    merged = both.groupBy(*place).agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.min_by("snippet", "list").alias("snippet"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_terms")))).alias("matched_terms")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start_line", "end_line")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select(*place, "snippet", "score", "matched_terms", "rank")
