"""Vectors: similarity search, pooling, refresh."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gleanery.errors import InvalidArgument
from gleanery.operators.best import Best

#: Numbers in the queries of one pass, and cells of a block's table of scores.
VALUES, CELLS = 1 << 23, 1 << 21


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str, b: str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for vectors of no length; an error for vectors of different sizes."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    value = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in size")).cast("double"))


def nearest(vectors: DataFrame, queries: DataFrame, top_k: int, tie: list[str] | None = None, part: bool = False) -> DataFrame:
    """vectors' columns but the vector, with query_id, score and rank: the top_k most similar rows (vector) of each query (query_id, query_vector).

    Queries are a stated set: they are sent to all, about VALUES numbers of them in one pass at most (a `part`), and every vector is scored where
    it lies, in blocks, all queries at once. Products add up in the order of dimensions, so equal vectors have equal scores
    everywhere. Norms are computed once a vector, and only each task's best rows of a query are shuffled. Vectors of no length
    score 0; vectors of another size than the queries are an error; null vectors have no score.
    """
    spark, tie = vectors.sparkSession, tie or [c for c in vectors.columns if c != "vector"]
    rest = [c for c in vectors.columns if c != "vector"]
    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    count, wide = asked.agg(F.count("*"), F.max(F.size("query_vector"))).first()
    groups = -(-count * max(1, wide or 1) // VALUES)
    if groups > 1 and not part:
        parts = [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(2 * groups)) == g) for g in range(2 * groups)]
        return reduce(DataFrame.unionByName, [nearest(vectors, p, top_k, tie, True) for p in parts])
    schema = StructType([queries.schema["query_id"], *(vectors.schema[c] for c in rest), StructField("score", DoubleType())])
    rows = asked.collect()
    if not rows:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    if len({len(r["query_vector"]) for r in rows}) > 1:
        raise InvalidArgument("vectors differ in size")
    shared = spark.sparkContext.broadcast(([r["query_id"] for r in rows], np.array([r["query_vector"] for r in rows], dtype=np.float64).T.copy()))

    def in_order(products: Iterator[np.ndarray], shape: tuple) -> np.ndarray:
        total = np.zeros(shape)
        for x in products:
            total += x
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        lengths = np.sqrt(in_order((x * x for x in q), (len(ids),)))
        best, size = Best(len(ids), top_k), max(16, CELLS // len(ids))
        for whole in batches:
            whole = whole.filter(pc.is_valid(whole.column(len(rest))))
            for low in range(0, whole.num_rows, size):
                batch = whole.slice(low, size)
                column = batch.column(len(rest))
                if set(pc.list_value_length(column).unique().to_pylist()) - {len(q)}:
                    raise InvalidArgument("vectors differ in size")
                ties = list(zip(*(batch.column(rest.index(c)).to_pylist() for c in tie), strict=True)) if tie else [()] * batch.num_rows
                order = sorted(range(batch.num_rows), key=ties.__getitem__)
                v = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(q))[order].T.copy()
                norms = lengths[:, None] * np.sqrt(in_order((x * x for x in v), (batch.num_rows,)))
                scores = in_order((a[:, None] * b for a, b in zip(q, v, strict=True)), norms.shape)
                scores = np.divide(scores, norms, out=np.zeros_like(scores), where=norms != 0)
                records: dict[int, tuple] = {}  # what is kept of a row, once for all queries that keep it
                for k, chosen in best.offered(scores):
                    for j in chosen.tolist():
                        if j not in records:
                            records[j] = tuple(batch.column(i)[order[j]].as_py() for i in range(len(rest)))
                        best.take(k, float(scores[k, j]), ties[order[j]], records[j])
                best.cut()
            types = [whole.schema.field(i).type for i in range(len(rest))]
        kept = best.entries()
        while some := list(islice(kept, 4096)):
            columns = [pa.array([e[i] for *_, e in some], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k, *_ in some]), *columns, pa.array([s for _, s, _ in some], pa.float64())], names)

    names = schema.fieldNames()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *tie)
    found = vectors.select(*rest, F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, schema)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def mean_pool(vectors: DataFrame, group: str, mask: str | None = None) -> DataFrame:
    """(group, vector): the mean of each group's vectors, made length 1 (zeros stay zeros). Sums are taken per dimension, before the shuffle.

    mask: a column that is 0 for rows that don't count (padding); a group without others has a vector of zeros.
    """
    counts = F.lit(True) if mask is None else F.coalesce(F.col(mask).cast("int") != 0, F.lit(False))
    long = vectors.select(group, counts.alias("counts"), F.posexplode("vector").alias("dim", "value"))
    means = long.groupBy(group, "dim").agg(F.coalesce(F.avg(F.when(F.col("counts"), F.col("value"))), F.lit(0.0)).alias("value"))
    rows = means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("parts")).select(group, F.transform("parts", lambda p: p["value"]).alias("vector"))
    return rows.select(group, F.when(norm("vector") == 0, F.col("vector")).otherwise(F.transform("vector", lambda v: v / norm("vector"))).alias("vector"))


def refresh_plan(stored: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, action): embed what has no vector, reuse what has, remove vectors without a chunk."""
    have, want = stored.select(key).distinct(), chunks.select(key).distinct()
    joined = want.withColumn("wanted", F.lit(True)).join(have.withColumn("stored", F.lit(True)), key, "full_outer")
    return joined.select(key, F.when(F.col("stored").isNull(), "embed").when(F.col("wanted").isNull(), "remove").otherwise("reuse").alias("action"))


def refreshed(stored: DataFrame, chunks: DataFrame, embed, key: str = "chunk_id") -> DataFrame:
    """(key, vector) for all chunks: stored vectors are reused, others come from `embed`, a pandas UDF of the text; failed ones (null) are left out."""
    reuse = stored.join(chunks.select(key), key, "left_semi").select(key, "vector")
    # a filter on what a mark stands beside isn't moved below the join, where it would embed all chunks
    mark = F.monotonically_increasing_id().alias("mark")
    new = chunks.join(stored.select(key), key, "left_anti").select(key, embed("text").alias("vector"), mark).where("vector is not null and mark >= 0")
    return reuse.unionByName(new.drop("mark"))
