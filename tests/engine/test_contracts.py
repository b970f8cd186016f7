import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.engine import Engine
from gleanery.errors import PathBlocked
from gleanery.functions import paths
from gleanery.operators import languages, lexical, outline, references, search, semantic
from gleanery.sources import corpus as sources


def test_impl_targets():
    cases = {
        "tuple": "tuple", "&mut Tree": "Tree", "&'a mut mutex": "mutex", "Show for ut::Mut": "Mut", "Iterator for Vec<T> where T: Ord": "Vec",
        "From<Vec<u8>> for Matrix": "Matrix", "for<'a> Turn<'a> for umt": "umt", "Turn for (A, B)": None, "Turn for [u8]": None, "dyn Shape": "Shape", "": None,
    }
    assert {k: languages._impl_target(k) for k in cases} == cases


def test_symbols_stand_in_order(spark):
    text = "impl B for C {\n    fn z(&self) {}\n}\nfn a() {}\n"
    rows = spark.createDataFrame([("b.rs", text), ("a.py", "def g():\n    pass\ndef f(): pass\nclass A:\n    x = 1\n    def m(self): pass\n")], "path string, text string")
    got = [(r.path, r.start_line, r.end_line, r.name, r.kind) for r in outline.ordered(outline.outline(rows)).collect()]
    assert got == sorted(got) and len(got) == 7
    per_file = [(r.path, r.start_line, r.end_line, r.name, r.kind) for r in outline.outline(rows.where("path = 'a.py'")).collect()]
    assert per_file == sorted(per_file)


def test_broken_symbols_and_references_are_errors(spark):
    symbols = spark.createDataFrame([("a", "python", "class", "A", None, 1, 2, None, None, scope, None, None) for scope in ("module", "world", None)], outline.SYMBOLS)
    assert [r.scope_kind for r in outline.violations(symbols).collect()] == ["world"]
    assert outline.checked(symbols.where("scope_kind is null")).count() == 1
    with pytest.raises(Exception, match="CONTRACT_VIOLATION"):
        outline.checked(symbols).collect()
    good = ("s", "p", 1, "call", "s()", "ast", "high")
    rows = spark.createDataFrame([good, (" ", *good[1:]), ("s", "p", 0, *good[3:]), (*good[:5], "guess", "high"), (*good[:6], "sure")], "symbol string, path string, line int, kind string, evidence string, strategy string, confidence string")
    assert references.violations(rows).count() == 4
    with pytest.raises(Exception, match="CONTRACT_VIOLATION"):
        references.checked(rows).collect()


def test_absolute_paths_below_the_root():
    assert paths.resolve("/data/src/a/../b.py", "/data/src") == "b.py"
    assert paths.resolve("/data/src/b.py", "file:///data/src/") == "b.py"
    for path, root in (("/data/src2/b.py", "/data/src"), ("/data/src/../x.py", "/data/src"), ("/data/src", "/data/src"), ("/b.py", None), ("C:/b.py", "/data")):
        with pytest.raises(PathBlocked):
            paths.resolve(path, root)


def test_identifier_columns_and_unmatched_braces(spark):
    text = "ab = cd // ef\n  é$x1 {}\n} } {\n\"{\" z\n"
    rows = spark.createDataFrame([("a", text), ("b", "{{}"), ("c", ""), ("d", "} {")], "path string, text string")
    got = sorted((r.line, r.token, r.start_col, r.end_col) for r in lexical.identifier_places(rows.where("path = 'a'")).collect())
    want = []
    for n, line in enumerate(["ab = cd ", "  é$x1 {}", "} } {", "    z"], 1):
        want += [(n, m.group(), m.start() + 1, m.end()) for m in re.finditer("[A-Za-z_$][A-Za-z0-9_$]*", line)]
    assert got == sorted(want)
    found = {r.path: (r.unmatched_open, r.unmatched_close) for r in lexical.unmatched_braces(rows).collect()}
    assert found == {"a": (1, 2), "b": (1, 0), "c": (0, 0), "d": (1, 1)}


def test_mean_pool_leaves_out_what_is_masked(spark):
    rows = spark.createDataFrame([("a", [3.0, 0.0], 1), ("a", [0.0, 9.0], 0), ("b", [1.0, 1.0], 0), ("c", [0.0, 2.0], None), ("c", [4.0, 0.0], 2)], "g string, vector array<double>, mask int")
    assert {r.g: r.vector for r in semantic.mean_pool(rows, "g", "mask").collect()} == {"a": [1.0, 0.0], "b": [0.0, 0.0], "c": [1.0, 0.0]}


def test_nearest_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(90, 7)), 1)
    v[10] = v[20] = v[30]
    v[5] = 0
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "id long, vector array<double>").repartition(5)
    asked = vectors.where("id in (5, 10, 40)").selectExpr("id as query_id", "vector as query_vector")
    for limits in ({}, {"VALUES": 7, "CELLS": 8}):
        for name, value in limits.items():
            monkeypatch.setattr(semantic, name, value)
        got = {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in semantic.nearest(vectors, asked, 6, ["id"]).collect()}
        for q in (5, 10, 40):
            norms = np.linalg.norm(v, axis=1) * np.linalg.norm(v[q])
            scores = np.round(np.divide(v @ v[q], norms, out=np.zeros(len(v)), where=norms != 0), 9)
            order = sorted(range(len(v)), key=lambda i: (-scores[i], i))[:6]
            assert [got[q, k + 1][0] for k in range(6)] == order


def test_blocks_of_queries_and_documents_change_nothing(spark, monkeypatch):
    rnd = random.Random(3)
    docs = [(str(i), f"p{i % 7}/f{i:03d}", 1, 2, " ".join(rnd.choice("red blue Red x y z w_1".split()) for _ in range(rnd.randrange(12)))) for i in range(120)]
    rows = spark.createDataFrame(docs, "chunk_id string, path string, start_line int, end_line int, text string").repartition(5)
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["red", "blue x", "", "nothing", "w_1 z y Z", "RED blue"])], "query_id long, query string")
    shown = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.score, tuple(r.matched_terms), r.snippet) for r in df.collect())
    whole = shown(search.bm25(rows, asked, 9))
    monkeypatch.setattr(search, "CELLS", 6)
    assert shown(search.bm25(rows, asked, 9)) == whole
    monkeypatch.setattr(search, "AT_ONCE", 2)
    assert shown(search.bm25(rows, asked, 9)) == whole
    stored = search.postings(rows).select("chunk_id", "term", "tf", "dl")
    measured = rows.withColumn("dl", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))))
    assert shown(search.bm25(measured, asked, 9, index=stored)) == whole


def test_deep_directories_are_listed_by_the_executors(spark, tmp_path):
    want = []
    for a in range(9):
        for b in range(9):
            folder = tmp_path / f"d{a}" / f"e{b}" / ("skipped" if b == 4 else "kept")
            folder.mkdir(parents=True)
            (folder / "f.txt").write_text("x" * a)
            if b != 4:
                want.append((f"d{a}/e{b}/kept/f.txt", a))
    (tmp_path / "top.txt").write_text("y")
    os.symlink(tmp_path / "top.txt", tmp_path / "link.txt")
    found = sources.list_directory(spark, str(tmp_path), ("skipped",))
    assert sorted((r.path, r.size) for r in found.collect()) == sorted([*want, ("top.txt", 1)])
    assert [r.size for r in sources.one_file(spark, str(tmp_path), "d3/e1/kept/f.txt").collect()] == [3]
    for path in ("d3", "link.txt", "no.txt", "../x"):
        assert sources.one_file(spark, str(tmp_path), path).count() == 0


def test_vectors_are_stored_and_reused(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    for name, text in (("a.py", "alpha beta"), ("b.py", "gamma"), ("c.py", "alpha")):
        (root / name).write_text(text)
    log = tmp_path / "embedded"

    @F.pandas_udf("array<double>")
    def embed(texts):
        with open(log, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return texts.map(lambda t: None if "gamma" in t else [float(t.count("alpha")), float(t.count("beta")), 1.0])

    engine = Engine(spark, str(tmp_path / "data"), root=str(root), embed=embed)
    engine.refresh()
    assert engine.store.read("vectors").count() == 2, "a text that can't be embedded has no vector"
    log.write_text("")
    hits = engine.search("alpha", mode="semantic").collect()
    assert [h.path for h in hits] == ["c.py", "a.py"] and set(log.read_text().split("\n")) == {"alpha", ""}
    (root / "c.py").write_text("beta beta")
    (root / "d.py").write_text("alpha new")
    log.write_text("")
    engine.refresh()
    assert set(log.read_text().split("\n")) == {"gamma", "beta beta", "alpha new", ""}, "only chunks without a vector are embedded"
    assert {r.action for r in engine.vector_plan().collect()} == {"reuse", "embed"}
    assert engine.store.read("vectors").count() == 3


def test_a_long_line_costs_no_more_than_short_ones(spark, monkeypatch):
    """Identifiers of one line, each by a sum over those before it and not by a copy of them."""
    monkeypatch.setattr(lexical, "PIECE", 1 << 15)
    rows = spark.createDataFrame([("long", "é " + " ".join(f"v{i % 10}" for i in range(250_000))), ("short", "a\n  b c\n")], "path string, text string")
    began = time.monotonic()
    found = lexical.identifier_places(rows)
    n, first, last, width = found.where("path = 'long'").agg(F.count("*"), F.min("start_col"), F.max("end_col"), F.max(F.col("end_col") - F.col("start_col"))).first()
    assert (n, first, last, width) == (250_000, 3, 2 + 3 * 250_000 - 1, 1) and time.monotonic() - began < 40
    assert sorted(map(tuple, lexical.identifier_places(rows.where("path = 'short'"), keys=["line"]).collect())) == [(1, "a", 1, 1), (2, "b", 3, 3), (2, "c", 5, 5)]
