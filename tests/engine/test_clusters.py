import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.errors import InvalidArgument
from gleanery.operators import clusters, semantic

SCHEMA = "vec_id long, vector array<double>"


def table(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in enumerate(rows)], SCHEMA)


def grouped(n, dims, groups, spread, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dims))
    return centers[rng.integers(0, groups, n)] * rng.uniform(0.1, 9, (n, 1)) + spread * rng.normal(size=(n, dims))


def plain(df):
    return sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("spread,top_k", [(0.05, 1), (0.05, 10), (1.0, 3), (0.0, 7)])
def test_equal_to_scoring_all(spark, spread, top_k):
    rows = [*grouped(1500, 12, 25, spread, top_k), *[np.zeros(12)] * 3, None, *grouped(4, 12, 1, 0, 1)]
    vectors = table(spark, rows).repartition(5)
    queries = table(spark, [*rows[:30], np.zeros(12), -np.array(rows[0])]).selectExpr("vec_id as query_id", "vector as query_vector")
    centroids = clusters.fit(vectors, 30)
    near = clusters.assigned(vectors, centroids)
    search = clusters.Search(near, centroids, queries, top_k, ["vec_id"])
    assert plain(search.hits()) == plain(semantic.nearest(vectors, queries, top_k, ["vec_id"]))
    report = {r.query_id: r for r in search.report().collect()}
    assert all(r.vectors == 1507 and r.scored <= r.vectors for r in report.values())
    if spread == 0.05:
        assert sum(report[i].scored for i in range(30)) < 0.4 * 30 * 1507
        assert report[30].scored == 1507  # a query without direction


def test_angles_bound_their_clusters(spark):
    rows = grouped(600, 6, 9, 0.4, 3)
    centroids = clusters.fit(table(spark, rows), 9)
    for r in clusters.assigned(table(spark, rows), centroids).collect():
        unit = np.array(r.vector) / np.linalg.norm(r.vector)
        assert r.cluster == (centroids @ unit).argmax() and abs(np.cos(r.angle) - (centroids @ unit).max()) < 1e-9


def test_small_tables(spark):
    none = table(spark, [])
    assert clusters.fit(none).shape == (0, 0) and clusters.assigned(none, clusters.fit(none)).collect() == []
    zeros = table(spark, [np.zeros(3)] * 4)
    queries = table(spark, [[1, 0, 0]]).selectExpr("vec_id as query_id", "vector as query_vector")
    found = clusters.Search(clusters.assigned(zeros, clusters.fit(zeros)), clusters.fit(zeros), queries, 2, ["vec_id"])
    assert plain(found.hits()) == [(0, 0, 0.0, 1), (0, 1, 0.0, 2)]
    assert clusters.Search(clusters.assigned(none, clusters.fit(none)), clusters.fit(none), queries, 2, ["vec_id"]).hits().collect() == []
    assert clusters.Search(clusters.assigned(zeros, clusters.fit(zeros)), clusters.fit(zeros), queries.limit(0), 2, ["vec_id"]).hits().collect() == []
    one = table(spark, [[1, 2, 3], [2, 4, 6]])
    with pytest.raises(InvalidArgument):
        clusters.Search(clusters.assigned(one, clusters.fit(one)), clusters.fit(one), table(spark, [[1, 2]]).selectExpr("vec_id as query_id", "vector as query_vector"), 1, ["vec_id"]).hits()


def test_clusters_that_no_query_needs_are_not_read(spark, tmp_path):
    rows = grouped(800, 8, 12, 0.01, 5)
    vectors = table(spark, rows)
    centroids = clusters.fit(vectors, 12)
    near = clusters.assigned(vectors, centroids)
    near.repartitionByRange("cluster").sortWithinPartitions("cluster").write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    queries = vectors.limit(1).selectExpr("vec_id as query_id", "vector as query_vector")
    found = clusters.Search(stored, centroids, queries, 3, ["vec_id"]).hits()
    assert "PushedFilters: [In(cluster" in found._jdf.queryExecution().toString() or "EqualTo(cluster" in found._jdf.queryExecution().toString()
    assert found.agg(F.count("*")).first()[0] == 3
