"""Exact similarity search that skips clusters of vectors which cannot hold a query's best."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gleanery.errors import InvalidArgument
from gleanery.operators.best import Best

#: Centroids are fitted on so many vectors at most, the first by a hash of their values; every vector is assigned, whatever the sample.
SAMPLE, MOST, PASSES, SEED = 20_000, 1024, 8, 7
#: Clusters of the best centroids that a query visits first, at least, and what bounds may lack by rounding.
SEEDS, SLACK = 2, 1e-9
#: Vectors that have no direction are a cluster of their own.
NOWHERE = -1


def _units(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def fit(vectors: DataFrame, k: int | None = None) -> np.ndarray:
    """Centroids (cluster, dimension) of length 1, by spherical k-means on a bounded sample of the vectors (column vector). k: some square root of the number of vectors, MOST at most."""
    usable = vectors.where("vector is not null").select(F.col("vector").cast("array<double>").alias("vector"))
    n = usable.count()
    sample = np.array([r["vector"] for r in usable.orderBy(F.xxhash64("vector")).limit(SAMPLE).collect()], dtype=float)
    sample = _units(sample)[np.linalg.norm(sample, axis=1) > 0] if len(sample) else sample
    if not len(sample):
        return np.zeros((0, 0))
    k = min(len(sample), MOST, k or max(1, int(np.sqrt(n))))
    centroids = sample[np.random.default_rng(SEED).choice(len(sample), k, replace=False)]
    for _ in range(PASSES):
        own = np.concatenate([(sample[i : i + 2048] @ centroids.T).argmax(axis=1) for i in range(0, len(sample), 2048)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        centroids = np.where((np.linalg.norm(sums, axis=1) > 0)[:, None], _units(sums), centroids)
    return centroids


def stored(centroids: DataFrame | None) -> np.ndarray:
    """Centroids from a table (cluster, centroid), of MOST rows at most."""
    rows = centroids.orderBy("cluster").collect() if centroids is not None else []
    return np.array([r["centroid"] for r in rows], dtype=float) if rows else np.zeros((0, 0))


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vectors with cluster (the centroid of the least angle) and that angle; null vectors are left out."""
    shared, columns = vectors.sparkSession.sparkContext.broadcast(centroids), vectors.columns
    at = columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            whole = whole.filter(pc.is_valid(whole.column(at)))
            for low in range(0, whole.num_rows, 2048):
                batch = whole.slice(low, 2048)
                rows = _units(np.array(batch.column(at).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(batch.num_rows, -1))
                if len(own) and rows.shape[1] != own.shape[1]:
                    raise InvalidArgument("vectors differ in size")
                cosines = rows @ own.T if len(own) else np.zeros((len(rows), 1))
                cluster = cosines.argmax(axis=1)
                angle = np.arccos(np.clip(cosines[np.arange(len(rows)), cluster], -1.0, 1.0))
                nowhere = ~rows.any(axis=1) | (len(own) == 0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(nowhere, NOWHERE, cluster).astype(np.int32)), pa.array(np.where(nowhere, 0.0, angle))], [*columns, "cluster", "angle"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{kinds}, cluster int, angle double")


class Search:
    """The top_k most similar rows of each query (query_id, query_vector) among vectors with cluster and angle; as semantic.nearest(), and equal to it.

    A row of a cluster is within the cluster's greatest angle of its centroid, so its angle to a query is at least the
    centroid's less that (the triangle inequality on the sphere). A cluster whose bound is below a query's k-th best score so far is
    not scored for it, and one that no query needs is not read. Queries are a stated set, sent to all; centroids are MOST at most.
    """

    def __init__(self, vectors: DataFrame, centroids: np.ndarray, queries: DataFrame, top_k: int, tie: list[str]):
        self.vectors, self.top_k, self.tie, self.queries = vectors, top_k, tie, queries
        rows = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("v")).collect()
        if len({len(r["v"]) for r in rows}) > 1:
            raise InvalidArgument("vectors differ in size")
        self.ids, self.q = [r["query_id"] for r in rows], np.array([r["v"] for r in rows], dtype=float).reshape(len(rows), len(rows[0]["v"]) if rows else 0)
        found = vectors.groupBy("cluster").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).orderBy("cluster").collect()  # a row for each centroid
        self.clusters, self.sizes = [r["cluster"] for r in found], np.array([r["n"] for r in found], dtype=np.int64)
        if not self.ids or not found:
            self.bounds = np.zeros((len(self.ids), len(found)))
            return
        radius, own = np.array([r["radius"] for r in found]), _units(self.q)
        self.bounds = np.ones((len(self.ids), len(found)))
        known = np.array([c != NOWHERE for c in self.clusters])
        if known.any() and len(centroids):
            if own.shape[1] != centroids.shape[1]:
                raise InvalidArgument("vectors differ in size")
            angles = np.arccos(np.clip(own @ centroids[np.array(self.clusters)[known]].T, -1.0, 1.0))
            self.bounds[:, known] = np.cos(np.maximum(0.0, angles - radius[known] - SLACK))
            self.bounds[:, ~known] = 0.0
            self.bounds[~own.any(axis=1)] = 0.0  # a query without direction is as near to all

    def _scored(self, visit: np.ndarray) -> DataFrame:
        """Each task's best of the clusters that a query visits (query, cluster)."""
        rest = [c for c in self.vectors.columns if c not in ("vector", "cluster", "angle")]
        needed = [c for c, v in zip(self.clusters, visit.any(axis=0), strict=True) if v]
        by_cluster = {c: np.flatnonzero(visit[:, i]) for i, c in enumerate(self.clusters)}
        shared = self.vectors.sparkSession.sparkContext.broadcast((self.ids, self.q, by_cluster))
        top_k, tie = self.top_k, self.tie
        schema = StructType([self.queries.schema["query_id"], *(self.vectors.schema[c] for c in rest), StructField("score", DoubleType())])

        def in_order(products: Iterator[np.ndarray], shape: tuple) -> np.ndarray:
            total = np.zeros(shape)
            for x in products:
                total += x
            return total

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, by_cluster = shared.value
            lengths, best, types = np.sqrt(in_order((x * x for x in q.T), (len(q),))), Best(len(ids), top_k), None
            for batch in batches:
                types = batch.schema
                clusters = batch.column(len(rest) + 1).to_numpy(zero_copy_only=False)
                ties = list(zip(*(batch.column(rest.index(c)).to_pylist() for c in tie), strict=True))
                for cluster in np.unique(clusters).tolist():
                    asked = by_cluster[cluster]
                    order = sorted(np.flatnonzero(clusters == cluster).tolist(), key=ties.__getitem__)
                    for low in range(0, len(order), 1024):
                        own = order[low : low + 1024]
                        v = np.array(batch.column(len(rest)).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(own), -1).T
                        if len(v) != q.shape[1]:
                            raise InvalidArgument("vectors differ in size")
                        norms = lengths[asked][:, None] * np.sqrt(in_order((x * x for x in v), (len(own),)))
                        scores = in_order((a[:, None] * b for a, b in zip(q[asked].T, v, strict=True)), norms.shape)
                        scores = np.divide(scores, norms, out=np.zeros_like(scores), where=norms != 0)
                        full = np.full((len(ids), len(own)), -np.inf)
                        full[asked] = scores
                        for k, chosen in best.offered(full):
                            for j in chosen[np.isfinite(full[k, chosen])].tolist():
                                best.take(k, float(full[k, j]), ties[own[j]], [batch.column(i)[own[j]].as_py() for i in range(len(rest))])
                        best.cut()
            kept = list(best.entries())
            if kept:
                columns = [pa.array([e[i] for *_, e in kept], types.field(i).type) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k, *_ in kept]), *columns, pa.array([s for _, s, _ in kept], pa.float64())], names)

        names = schema.fieldNames()
        rows = self.vectors.where(F.col("cluster").isin(needed)) if len(needed) < len(self.clusters) else self.vectors
        return rows.select(*rest, F.col("vector").cast("array<double>").alias("vector"), "cluster").mapInArrow(run, schema)

    def visited(self) -> np.ndarray:
        """(query, cluster): what has to be scored, learned from the clusters of greatest bounds."""
        first = np.zeros(self.bounds.shape, dtype=bool)
        for i, bounds in enumerate(self.bounds):
            order = np.argsort(-bounds, kind="stable")
            enough = int(np.searchsorted(np.cumsum(self.sizes[order]), self.top_k)) + 1
            first[i, order[: max(SEEDS, enough)]] = True
        if first.all():
            return first
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        ranked = self._scored(first).select("query_id", "score").withColumn("at", F.row_number().over(order)).where(F.col("at") <= self.top_k)
        least = {r["query_id"]: r["score"] for r in ranked.where(F.col("at") == self.top_k).collect()}  # a number for each query
        return first | (self.bounds + SLACK >= np.array([least.get(x, -np.inf) for x in self.ids])[:, None])

    def hits(self) -> DataFrame:
        """vectors' columns with query_id, score and rank."""
        if not self.ids or not self.clusters:
            rest = [self.vectors.schema[c] for c in self.vectors.columns if c not in ("vector", "cluster", "angle")]
            return self.vectors.sparkSession.createDataFrame([], StructType([self.queries.schema["query_id"], *rest, StructField("score", DoubleType())])).withColumn("rank", F.lit(0))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), *self.tie)
        return self._scored(self.visited()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.top_k)

    def report(self) -> DataFrame:
        """(query_id, vectors, scored): how many of the vectors are scored for each query."""
        visit = self.visited() if self.ids and self.clusters else np.zeros(self.bounds.shape, dtype=bool)
        rows = [(x, int(self.sizes.sum()), int(self.sizes[v].sum())) for x, v in zip(self.ids, visit, strict=True)]
        return self.vectors.sparkSession.createDataFrame(rows, StructType([self.queries.schema["query_id"], *StructType.fromDDL("vectors long, scored long")]))
