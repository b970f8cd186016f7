import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.engine import Engine
from gleanery.errors import InvalidArgument
from gleanery.operators import latent, search

TOPICS = {"sea": "ship wave harbor sail anchor tide".split(), "food": "bread soup salt oven spoon flour".split(), "code": "parse token index branch merge commit".split()}


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        topic = list(TOPICS)[k % 3]
        out.append((f"{topic}/{k:03d}.md", " ".join(rng.choices(TOPICS[topic], k=rng.randint(4, 25)) + rng.choices(["the", "of", "Un_1"], k=3))))
    return out


def test_vectors_are_the_leading_singular_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(latent, "ENTRIES", 37)
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts(90))], "doc long, text string").repartition(5)
    postings = search.postings(docs, "doc").select("doc", "term", "tf")

    def keep(rows):
        rows.write.parquet(str(tmp_path / "rows"))
        return spark.read.parquet(str(tmp_path / "rows"))

    model = latent.fit(postings, ["doc"], 90, keep, dimensions=4, passes=12)
    place = {t: i for i, t in enumerate(model.terms)}
    dense = np.zeros((90, len(place)))
    for r in postings.collect():
        dense[r.doc, place[r.term]] = (1 + np.log(r.tf)) * model.idf[place[r.term]]
    df = (dense > 0).sum(axis=0)
    np.testing.assert_allclose(model.idf, np.log(1 + 90 / df))
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    right = np.linalg.svd(dense, full_matrices=False)[2][:4].T
    np.testing.assert_allclose(np.abs((model.vectors * right).sum(axis=0)), 1.0, atol=1e-6)
    np.testing.assert_allclose(model.vectors.T @ model.vectors, np.eye(4), atol=1e-9)
    one = latent.embedder(spark, model)
    rows = spark.createDataFrame([("ship WAVE wave unknown",), ("unknown",), ("",), (None,)], "text string").select(one("text").alias("v")).collect()
    weights = np.zeros(len(place))
    weights[place["ship"]], weights[place["wave"]] = model.idf[place["ship"]], (1 + np.log(2)) * model.idf[place["wave"]]
    want = weights @ model.vectors
    np.testing.assert_allclose(rows[0].v, want / np.linalg.norm(want), rtol=1e-9)
    assert rows[1].v == rows[2].v == [0.0] * 4 and rows[3].v is None
    again = latent.stored(latent.table(spark, model))
    assert again.terms == sorted(model.terms) and np.allclose(again.vectors[again.terms.index("ship")], model.vectors[place["ship"]])
    assert latent.fit(postings.limit(0), ["doc"], 0, lambda r: r) is None


def test_an_engine_with_its_own_embedder(spark, tmp_path):
    files = dict(texts(60))
    table = lambda: spark.createDataFrame(list(files.items()), "path string, text string")
    engine = Engine(spark, str(tmp_path / "d"), files=table(), embed="latent")
    engine.refresh()
    hits = engine.search(["harbor tide", "soup oven", "merge branch"], mode="semantic", top_k=10).collect()
    assert len(hits) == 30 and all(r.path.startswith(("sea/", "food/", "code/")[r.query_id]) for r in hits)
    assert engine.search("salt flour", mode="hybrid", top_k=3).first().path.startswith("food/")
    files |= {"sea/new.md": "harbor harbor tide", "food/001.md": "tide harbor"}
    engine.table = table()
    done = engine.refresh()
    assert (done["added"], done["updated"]) == (1, 1)
    stored = engine.store.read("vectors")
    assert stored.count() == len(files) and engine.store.read("latent", live=False).count() > 10
    assert engine.search("harbor tide", mode="semantic", top_k=3).where(F.col("path").isin("sea/new.md", "food/001.md")).count() == 2
    engine.optimize()
    assert engine.search("harbor tide", mode="semantic", top_k=3).where(F.col("path").isin("sea/new.md", "food/001.md")).count() == 2
    with pytest.raises(InvalidArgument):
        Engine(spark, str(tmp_path / "e"), files=table(), embed="other")
