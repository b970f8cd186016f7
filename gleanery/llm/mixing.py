"""Mixing sources to target weights by capped water-filling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import WORD, fresh, stash, stored_rows, with_uid

#: Slots of the hash order in which documents are given one more repetition.
SLOTS = 4096


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """sources (weight, cap, ...) with a column `target`: weight * level, but at most cap; targets add up to `total`.

    The level starts as total / sum(weight). Sources above their caps are clamped, what is left of the total is shared by
    weight among the others, and so on until none is above. If all are clamped, the targets stay below the total. Each
    round is one aggregation; two sums reach the driver.
    """
    level, clamped = 0.0, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight") if clamped >= 0 else F.lit(False)
        full, weight, count = sources.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if count == clamped or not weight:
            break
        level, clamped = (total - (full or 0.0)) / weight, count
    return sources.withColumn("target", F.when(F.lit(not weight), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))))


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_rank(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source) with weights given out in turn, in order of the names' code points, null last. One row per source: small."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))


def mix(docs: DataFrame, share: float = 1.5, max_epochs: int = 2, weights: tuple[int, ...] = (5, 2, 1), seed: int = 7, text: str = "text") -> DataFrame:
    """One row per document: uid, doc_id, source, size, source_size, target (its source's), repeats, taken = repeats * size.

    Sources share `share` of all words by weight, none beyond `max_epochs` times its own size. With r = target / source_size,
    every document is repeated floor(r) times, and once more if it comes early enough in a seeded order (md5 of seed and id)
    to fill the rest; the document on the border is added if that brings the sum nearer. The order is kept as a histogram
    of hash slots per source (pre-aggregated), so only the slot on the border is sorted: no source's rows meet in one task,
    even if it holds most of them. Null texts and texts without words have size 0 and take 0 words; a null source is a source
    of its own, the last; a null doc_id orders by its seed alone and ties go by row; repeated rows count one by one; an empty
    table gives an empty result. Reruns agree.
    """
    docs = stored_rows(docs)
    md5 = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id")).cast("binary"))
    sized = with_uid(docs.select("doc_id", "source", size_of(text).alias("size")))
    sized = stash(sized, "mixing-sizes").withColumn("draw", md5).withColumn("slot", F.conv(F.substring("draw", 1, 3), 16, 10).cast("int"))
    # zero-size documents take nothing and so never count
    slots = stash(sized.groupBy("source", "slot").agg(F.sum("size").alias("size")), "mixing-slots")
    sources = by_rank(slots.groupBy("source").agg(F.sum("size").alias("source_size")), weights).withColumn("cap", F.col("source_size") * max_epochs)
    total = slots.agg(F.sum("size")).first()[0] or 0
    plan = water_fill(stash(sources, "mixing-sources"), share * total).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).drop("weight", "cap")
    along = Window.partitionBy("source").orderBy("slot")
    filled = slots.join(plan.select(F.col("source").alias("of"), "rest"), F.col("source").eqNullSafe(F.col("of"))).withColumn("before", F.sum("size").over(along) - F.col("size"))
    border = filled.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))).select("of", F.col("slot").alias("border"), "before")
    plan = stash(plan.join(border.groupBy("of").agg(F.min("border").alias("border"), F.min("before").alias("before")), F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumnRenamed("source", "of"), "mixing-plan")
    planned = sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    sure = planned.where(F.col("border").isNull() | (F.col("slot") != F.col("border"))).withColumn("extra", (F.col("rest") > 0) & (F.col("border").isNull() | (F.col("slot") < F.col("border"))))
    row = Window.partitionBy("source").orderBy("draw", "doc_id", "uid")
    edge = planned.where(F.col("slot") == F.col("border")).withColumn("extra", F.col("before") + F.sum("size").over(row) - F.col("size") / 2 <= F.col("rest"))
    both = sure.unionByName(edge).withColumn("repeats", F.col("whole") + F.when(F.col("extra") & (F.col("whole") < max_epochs), 1).otherwise(0))
    return both.select("uid", "doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def repeated(docs: DataFrame, **kwargs) -> DataFrame:
    """docs with every row as often as mix() says; wordless documents, which cost no words, stay once."""
    docs = stored_rows(docs)
    uid, of, times, time = fresh(docs, "uid", "of", "times", "time")
    plan = mix(docs, **kwargs).select(F.col("uid").alias(of), F.when(F.col("size") > 0, F.col("repeats")).otherwise(1).alias(times))
    wanted = with_uid(docs, uid).join(plan.where(F.col(times) > 0), F.col(uid) == F.col(of))
    return wanted.withColumn(time, F.explode(F.sequence(F.lit(1), times))).drop(uid, of, times, time)
