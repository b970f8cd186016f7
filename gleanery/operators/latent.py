"""An embedder of the engine's own: latent semantic vectors from the postings, by randomized subspace iteration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gleanery.functions import text as T

#: Dimensions of a vector, further directions that are carried along, passes over the documents, and the seed of the first directions.
DIMENSIONS, EXTRA, PASSES, SEED = 64, 16, 5, 11
#: Terms that count: those of the greatest document frequency. Bounds what the driver and each task hold (VOCABULARY times directions, 8 bytes each).
VOCABULARY = 50_000
#: Documents that the directions are learned from, by a hash; every document gets a vector, whatever the sample.
SAMPLE = 2_000_000
#: Entries of the documents' matrix that are multiplied at once.
ENTRIES = 50_000
TABLE = "term string, idf double, vector array<double>"


class Model(NamedTuple):
    terms: list[str]
    idf: np.ndarray
    vectors: np.ndarray  # (term, dimension), orthonormal columns


def matrix(postings: DataFrame, keys: list[str], terms: DataFrame, share: float = 1.0) -> DataFrame:
    """(ids, weights): a row of unit length for each document (keys) of postings (keys, term, tf): (1 + ln tf) * idf of its terms (term, id, idf)."""
    if share < 1.0:
        postings = postings.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(share * (1 << 30)))
    met = postings.join(F.broadcast(terms), "term").select(*keys, "id", ((F.lit(1.0) + F.log("tf")) * F.col("idf")).alias("w"))  # VOCABULARY rows
    rows = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "w"))).alias("x"))
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e["w"] * e["w"]))
    return rows.select(F.transform("x", lambda e: e["id"]).alias("ids"), F.transform("x", lambda e: e["w"] / length).alias("weights"))


def _product(rows: DataFrame, directions: np.ndarray) -> np.ndarray:
    """A'(A directions) for the matrix A of rows: each task multiplies its rows twice and sends a row for each of its terms; these are summed by term."""
    shared, wide = rows.sparkSession.sparkContext.broadcast(directions), directions.shape[1]

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        total, touched = np.zeros_like(own), np.zeros(len(own), dtype=bool)
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(0)], dtype=np.int64)
            ids, weights = batch.column(0).flatten().to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            low = 0
            while low < len(sizes):
                start = ends[low] - sizes[low]
                high = max(low + 1, int(np.searchsorted(ends, start + ENTRIES, side="right")))
                i, w = ids[start : ends[high - 1]], weights[start : ends[high - 1]]
                bounds = ends[low:high] - sizes[low:high] - start
                y = np.add.reduceat(own[i] * w[:, None], bounds, axis=0)  # no document is without terms
                back = y[np.repeat(np.arange(high - low), sizes[low:high])] * w[:, None]
                order = np.argsort(i, kind="stable")
                found, first = np.unique(i[order], return_index=True)
                total[found] += np.add.reduceat(back[order], first, axis=0)
                touched[found] = True
                low = high
        yield rows_of(np.flatnonzero(touched), total[touched])

    def rows_of(ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, wide, dtype=np.int32)), pa.array(values.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), lists], ["id", "x"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # the terms of one partition
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
            for k, v in zip(batch.column(0).to_pylist(), values, strict=True):
                total[k] = total[k] + v if k in total else v.copy()
        if total:
            yield rows_of(np.array(list(total)), np.array(list(total.values())))

    kind = "id int, x array<double>"
    found = rows.mapInArrow(multiplied, kind).repartition("id").mapInArrow(summed, kind).toArrow()
    out = np.zeros_like(directions)
    if found.num_rows:
        out[found["id"].to_numpy()] = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
    shared.unpersist()
    return out


def fit(postings: DataFrame, keys: list[str], n: int, keep: Callable[[DataFrame], DataFrame], dimensions: int = DIMENSIONS, passes: int = PASSES) -> Model | None:
    """The leading right singular vectors of the documents' weights, or None without terms.

    postings: keys, term, tf of n documents; keep: writes the documents' rows and reads them back, as each pass reads them. A pass
    multiplies the directions by A'A where the documents lie, and the driver orthonormalizes the result (VOCABULARY rows); the
    last product's small Gram matrix gives the vectors. Sums depend on the order of tasks in the last bits.
    """
    spark = postings.sparkSession
    found = postings.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(VOCABULARY).collect()
    if not found:
        return None
    terms, idf = [r["term"] for r in found], np.log(1.0 + n / np.array([r["df"] for r in found], dtype=float))
    rows = keep(matrix(postings, keys, spark.createDataFrame(list(zip(terms, range(len(terms)), idf.tolist(), strict=True)), "term string, id int, idf double"), SAMPLE / max(n, 1)))
    wide = min(dimensions + EXTRA, len(terms))
    directions = np.linalg.qr(np.random.default_rng(SEED).normal(size=(len(terms), wide)))[0]
    for _ in range(passes):
        directions = np.linalg.qr(_product(rows, directions))[0]
    _, turn = np.linalg.eigh(directions.T @ _product(rows, directions))
    vectors = directions @ turn[:, ::-1][:, :dimensions]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Model(terms, idf, vectors * np.where(signs == 0, 1.0, signs))


def table(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame(list(zip(model.terms, model.idf.tolist(), model.vectors.tolist(), strict=True)), TABLE)


def stored(rows: DataFrame | None) -> Model | None:
    """A model from its table (of VOCABULARY rows at most)."""
    found = rows.orderBy("term").collect() if rows is not None else []
    return Model([r["term"] for r in found], np.array([r["idf"] for r in found]), np.array([r["vector"] for r in found])) if found else None


def embedder(spark: SparkSession, model: Model) -> Callable:
    """A pandas UDF from text to its vector: the text's weights times the terms' vectors, of unit length. Texts without a known term give zeros, null texts null."""
    shared = spark.sparkContext.broadcast(({t: i for i, t in enumerate(model.terms)}, model.idf, model.vectors))
    token = re.compile(T.TOKEN)

    def one(text: str | None) -> list[float] | None:
        if text is None:
            return None
        place, idf, vectors = shared.value
        counts = Counter(place[t] for t in map(str.lower, token.findall(text)) if t in place)
        if not counts:
            return [0.0] * vectors.shape[1]
        ids = np.fromiter(sorted(counts), dtype=np.int64)
        weights = (1.0 + np.log([counts[i] for i in ids.tolist()])) * idf[ids]
        out = weights @ vectors[ids]
        length = np.linalg.norm(out)
        return (out / length if length else out).tolist()

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action=None).astype(object)

    return embed
