import os
import time

import pytest

from gleanery.sources import corpus, files
from gleanery.streaming import streams


@pytest.fixture
def root(tmp_path):
    for k in range(300):
        at = tmp_path / "tree" / f"d{k % 100}" / f"e{k % 7}" / f"f{k}.{'py' if k % 2 else 'md'}"
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x" * k)
    (tmp_path / "tree/.hidden").mkdir()
    (tmp_path / "tree/.hidden/a.py").write_text("h")
    (tmp_path / "tree/build").mkdir()
    (tmp_path / "tree/build/b.py").write_text("b")
    os.symlink("/etc", tmp_path / "tree/link")
    return str(tmp_path / "tree")


@pytest.fixture(autouse=True)
def pushdown(spark):
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)


def test_listing_equals_the_walk(spark, root):
    files.register(spark)
    read = lambda **o: spark.read.format("gleanery_files").options(root=root, **o).load()
    plain = lambda df: sorted(map(tuple, df.collect()))
    assert plain(read()) == plain(corpus.list_directory(spark, root)) and read().count() == 302
    assert plain(read(excluded="build,.hidden")) == plain(corpus.list_directory(spark, root, ("build", ".hidden")))
    assert read().rdd.getNumPartitions() > 10


def test_filters_reach_the_listing(spark, root):
    files.register(spark)
    every = sorted(map(tuple, corpus.list_directory(spark, root).collect()))
    for where, has in (
        ("path like 'd1/%'", lambda p, n: p.startswith("d1/")), ("path like 'd1%' and path like '%.py' and size > 20 and size <= 200", lambda p, n: p.startswith("d1") and p.endswith(".py") and 20 < n <= 200),
        ("size = 33", lambda p, n: n == 33), ("size >= 290 and size < 298 and mtime_ns > 0", lambda p, n: 290 <= n < 298), ("path like 'zz%'", lambda p, n: False), ("path like '%3%'", lambda p, n: "3" in p),
    ):
        df = spark.read.format("gleanery_files").option("root", root).load().where(where)
        assert sorted(map(tuple, df.collect())) == [r for r in every if has(r[0], r[1])], where
    plan = spark.read.format("gleanery_files").option("root", root).load().where("path like 'd1/%' and size > 20")._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan.split("BatchScan")[0] and "> 20" not in plan.split("BatchScan")[0]  # nothing is left for a filter after the scan


def test_directories_outside_a_prefix_are_not_entered(root):
    tree = files._Tree({"root": root})
    tree.wanted = files.Wanted(prefixes=("d1/e1/",))
    parts = tree.plan()
    assert [p.directory for p in parts if p.directory] == [] and {f[0].rpartition("/")[0] for p in parts for f in p.files} == {"d1/e1"}
    assert not files.Wanted(prefixes=("d1/",)).may_hold("d12") and files.Wanted(prefixes=("d1",)).may_hold("d12") and files.Wanted(prefixes=("a/b/c",)).may_hold("a")
    with pytest.raises(ValueError):
        files._Tree({})


def test_a_directory_becomes_a_stream_of_changes(spark, tmp_path):
    files.register(spark)
    root = tmp_path / "live"
    root.mkdir()
    (root / "a.py").write_text("1")
    (root / "b.py").write_text("1")
    listed = spark.readStream.format("gleanery_listings").option("root", str(root)).load()
    query = streams.file_changes(listed, absent="8 seconds", late="0 seconds").writeStream.format("memory").queryName("live_changes").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="1 second").start()
    seen = lambda: {(r.path, r.change) for r in spark.table("live_changes").collect()}

    def until(want, limit=90):
        end = time.time() + limit
        while time.time() < end and not want <= seen():
            time.sleep(0.5)
        assert want <= seen()

    try:
        until({("a.py", "added"), ("b.py", "added")})
        (root / "a.py").write_text("22")
        (root / "c.py").write_text("3")
        until({("a.py", "updated"), ("c.py", "added")})
        (root / "b.py").unlink()
        until({("b.py", "removed")})
        assert ("a.py", "removed") not in seen() and ("c.py", "removed") not in seen()
    finally:
        query.stop()
