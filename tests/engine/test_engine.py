import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gleanery.config import Limits, Settings
from gleanery.engine import Engine
from gleanery.errors import EngineError, InvalidArgument, PathBlocked, PolicyBlocked, SchemaUnsupported
from gleanery.operators import audit
from gleanery.plans import documents, samples
from gleanery.plans.store import MANIFEST, SCHEMA_VERSION
from gleanery.streaming import streams


@pytest.fixture
def root(tmp_path):
    for path, text in {**samples.FILES, ".env": "X=1", "keys/a.pem": "k", "build/x.py": "y = 1", ".hidden/h.md": "h", "bin.py": "\0", "tests/test_store.py": "from app.store import Store\n"}.items():
        at = tmp_path / "repo" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    os.symlink("/etc", tmp_path / "repo" / "link")
    return tmp_path


@pytest.fixture
def engine(spark, root):
    return Engine(spark, str(root / "data"), root=str(root / "repo"))


@F.pandas_udf(ArrayType(DoubleType()))
def embed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [float(t.lower().count(w)) for w in ("store", "panel", "server", "core")])


def test_refresh_and_search(spark, root, engine):
    assert engine.status()["index_status"] == "not_indexed"
    with pytest.raises(EngineError):
        engine.search("store").collect()
    first = engine.refresh()
    assert first["added"] == len(samples.FILES) + 2 and first["updated"] == first["removed"] == 0  # the hidden note and the test
    assert engine.refresh() | {"timestamp": 0} == {"added": 0, "updated": 0, "removed": 0, "timestamp": 0}
    (root / "repo/app/store.py").write_text("class Store:\n    shelf = 1\n")
    os.remove(root / "repo/docs/notes.md")
    assert engine.refresh() | {"timestamp": 0} == {"added": 0, "updated": 1, "removed": 1, "timestamp": 0}
    hits = engine.search(["shelf", "listen port"]).collect()
    assert [(r.query_id, r.path) for r in hits] == [(0, "app/store.py"), (1, "srv/main.go")] and hits[0].matched_terms == ["shelf"]
    assert engine.refresh(force=True)["updated"] == len(samples.FILES) + 1
    assert engine.status()["index_status"] == "ready" and engine.status()["indexed_file_count"] == len(samples.FILES) + 1
    with pytest.raises(PolicyBlocked):
        engine.search("x", top_k=51)
    for bad in ({"top_k": 0}, {"top_k": True}, {"mode": "magic"}):
        with pytest.raises(InvalidArgument):
            engine.search("x", **bad)
    with pytest.raises(EngineError):
        engine.search("x", mode="hybrid")


def test_semantic_and_hybrid(spark, root):
    e = Engine(spark, str(root / "data"), root=str(root / "repo"), embed=embed)
    e.refresh()
    assert e.search("the panel", mode="semantic", top_k=3).first().path == "web/view.ts"
    both = e.search("panel", mode="hybrid", top_k=5).collect()
    assert {r.path for r in both[:2]} == {"docs/notes.md", "web/view.ts"} and both[0].score <= 2 / 61


def test_newer_schemas_are_refused(spark, engine):
    engine.refresh()
    spark.createDataFrame([(SCHEMA_VERSION + 1, 2, "9999", 0, 0, True, [])], MANIFEST).write.parquet(f"{engine.store.root}/manifest/v-000000000002")
    assert engine.status()["index_status"] == "schema_mismatch"
    with pytest.raises(SchemaUnsupported):
        engine.search("x")


def test_files(engine):
    paths = [r.path for r in engine.list_files().collect()]
    assert paths == sorted(paths, key=lambda p: p.split("/")) and ".env" not in paths and "keys/a.pem" not in paths and "build/x.py" in paths and ".hidden/h.md" not in paths
    assert ".hidden/h.md" in [r.path for r in engine.list_files(include_hidden=True).collect()]
    assert [r.path for r in engine.list_files(glob="*.go", max_results=-3).collect()] == ["srv/main.go"]
    assert [(r.line, r.text) for r in engine.open_file("docs/notes.md", 1, 2).collect()] == [(1, "# Notes"), (2, "")]
    assert engine.open_file("docs/notes.md").count() == 3 and engine.open_file("missing.md").collect() == []
    for bad, error in ((".env", PolicyBlocked), ("../x", PathBlocked), ("/etc/passwd", PathBlocked)):
        with pytest.raises(error):
            engine.open_file(bad)
    with pytest.raises(InvalidArgument):
        engine.open_file("docs/notes.md", 3, 2)
    with pytest.raises(PolicyBlocked):
        engine.open_file("docs/notes.md", 1, 5000)


def test_symbols(engine):
    assert engine.outline("app/store.py").count() == 5
    assert {r.path for r in engine.references("Store").collect()} == {"app/store.py", "tests/test_store.py"}
    assert [r.start_line for r in engine.find_definition("load").collect()] == [8]
    with pytest.raises(InvalidArgument):
        engine.references(" ")


def test_bundle(engine):
    engine.refresh()
    out = engine.bundle("store load rows", 2, 30)
    chosen = out["selections"].orderBy("selection_index").collect()
    assert chosen[0].path == "app/store.py" and not any(r.path.startswith("tests/") for r in chosen)
    sums = out["totals"].first()
    assert sums.selected_files <= 2 and sums.selected_lines <= 30
    made = json.loads(out["documents"].first().document)
    assert made["selections"][0]["path"] == "app/store.py" and made["citations"][0]["selection_index"] == 0 and made["strategy"] == "bm25"
    assert made["audit"]["search_queries"] == ["store load rows", "store", "load", "rows"] and made["audit"]["dedupe_counts"]["before"] >= made["audit"]["dedupe_counts"]["after"]
    assert set(made["audit"]["selection_debug"]["why_not_selected_summary"]["reason_counts"]) == {"file_budget", "line_budget", "zero_lines", "other"}
    folder = f"{engine.data_dir}/bundle"
    assert documents.export(out["documents"].first().document, folder) == []
    assert json.load(open(f"{folder}/last_bundle.json")) == made and "### Selection 1\n- path: `app/store.py`" in open(f"{folder}/last_bundle.md").read()
    assert len(documents.export(out["documents"].first().document, "/proc/none")) == 2
    assert out["ids"].first().bundle_id == engine.bundle("store load rows", 2, 30)["ids"].first().bundle_id


def test_tables_and_responses(spark, root):
    e = Engine(spark, str(root / "other"), files=samples.corpus(spark), settings=Settings(limits=Limits(max_total_bytes_per_response=200)))
    assert e.refresh()["added"] == len(samples.FILES)
    assert json.loads(e.response(e.search("listen port", top_k=1).select("path", "rank"))) == [{"path": "srv/main.go", "rank": 1}]
    with pytest.raises(PolicyBlocked):
        e.response(e.outline())


def test_audit(spark, engine):
    assert engine.audit_log().collect() == []
    engine.log("repo.search", {"query": "my secret", "top_k": 5, "path": "a", "tags": [1, 2], "more": {"b": 1}, "x": None, "force": True})
    engine.log("repo.status", {}, ok=False, error_code="X")
    rows = engine.audit_log().collect()
    assert [r.tool for r in rows] == ["repo.search", "repo.status"]
    assert rows[0].metadata == {"query_present": "true", "query_length": "9", "top_k": "5", "path": '"a"', "tags_type": '"list"', "tags_length": "2", "more_type": '"dict"', "more_keys": '["b"]', "x": "null", "force": "true"}
    assert engine.audit_log(since=rows[1].timestamp).count() >= 1 and engine.audit_log(limit=1).first().tool == "repo.status"
    assert audit.sanitized({"mode": "m", "note": "n"}) == {"mode": "m", "note_present": True, "note_length": 1}
    stream = streams.audit_stream(spark, f"{engine.data_dir}/audit").writeStream.format("memory").queryName("audit_rows").trigger(availableNow=True).start()
    stream.awaitTermination()
    assert spark.table("audit_rows").count() == 2


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", "x\ny"), ("b", "z")], "path string, text string").write.parquet(str(tmp_path / "in"))
    seen = []
    q = streams.chunk_arrivals(spark, str(tmp_path / "in"), lambda df, _: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(seen) == ["a", "b"]
    events = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet*")
    counts = streams.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")))
    q = counts.writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < spark.table("counted").agg(F.sum("n")).first()[0] <= 1000
