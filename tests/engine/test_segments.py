import random
import time

import pytest
from pyspark.sql import functions as F

from gleanery.engine import Engine
from gleanery.operators import blocks, names, references, search
from gleanery.plans import store as store_module
from gleanery.plans.store import Store

WORDS = "alpha beta gamma delta load store panel server core turn widget".split()


def source(k: int, rng: random.Random) -> tuple[str, str]:
    """A file of some language with random words and names."""
    word = lambda: rng.choice(WORDS)
    kind = k % 4
    if kind == 0:
        return f"pkg/m{k}.py", f"import {word()}\n\nclass C{k}(Base):\n    def {word()}(self):\n        return {word()}({rng.randint(0, 9)})\n"
    if kind == 1:
        return f"srv/m{k}.go", f"package p\n\nfunc {word()}{k}(x int) int {{\n\treturn {word()}(x) // {word()}\n}}\n"
    if kind == 2:
        return f"web/m{k}.ts", f"import {{ {word()} }} from './{word()}';\nexport class W{k} {{\n  {word()}() {{ return new {word()}(); }}\n}}\n"
    return f"docs/m{k}.md", "\n".join(" ".join(rng.choices(WORDS, k=6)) for _ in range(rng.randint(0, 9)))


def table(spark, files: dict[str, str]):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def contents(engine: Engine) -> dict[str, list]:
    """All that the index says, in an order of its own."""
    plain = lambda df: sorted(map(str, df.collect()))
    read = engine.store.read
    tables = {n: plain(read(n).drop("doc", "range")) for n in ("files", "texts", "chunks", "symbols", "uses", "names")}
    postings = engine.store.read("blocks", live=False, segment=True).select("_seg", "term", F.explode("docs").alias("x")).select("_seg", "term", "x.*")
    alive = read("chunks", segment=True).select("_seg", "doc", "chunk_id")
    tables["postings"] = plain(postings.join(alive, ["_seg", "doc"]).select("chunk_id", "term", "tf", "dl"))
    hits = engine.search(["alpha load", "panel", "store core turn delta", "nothing here"], top_k=7)
    return tables | {"hits": plain(hits), "refs": plain(engine.references(WORDS, top_k=20)), "definitions": plain(engine.find_definition(WORDS)), "outline": plain(engine.outline())}


@pytest.mark.parametrize("seed", [1])
def test_random_refreshes_equal_a_rebuild(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(store_module, "TIER_BYTES", 60_000)  # so that some tiers fill up
    rng = random.Random(seed)
    files = dict(source(k, rng) for k in range(24))
    engine = Engine(spark, str(tmp_path / "data"), files=table(spark, files))
    engine.refresh()
    most = merges = 0
    for step in range(20):
        before = dict(files)
        for _ in range(rng.randint(0, 3)):
            path, text = source(rng.randrange(30), rng)
            files.pop(path, None) if rng.random() < 0.3 else files.__setitem__(path, text)
        engine.table = table(spark, files) if files else spark.createDataFrame([], "path string, text string")
        done = engine.refresh()
        changed = {p for p in files if p in before and files[p] != before[p]}
        assert (done["added"], done["updated"], done["removed"]) == (len(files.keys() - before.keys()), len(changed), len(before.keys() - files.keys()))
        assert engine.status()["indexed_file_count"] == len(files)
        segments = engine.store.manifest()["segments"]
        most, merges = max(most, len(segments)), merges + (len(segments) == 1)
    fresh = Engine(spark, str(tmp_path / "fresh"), files=engine.table)
    fresh.refresh()
    want = contents(fresh)
    assert contents(engine) == want and engine.status()["indexed_chunk_count"] == fresh.status()["indexed_chunk_count"]
    assert most > 1
    engine.optimize()
    assert len(engine.store.manifest()["segments"]) == 1 and not engine.store.has_marks()
    assert contents(engine) == want
    folders = engine.store._names(f"{engine.store.root}/segments")
    named = {s["id"] for v in engine.store._versions() for s in engine.store._manifest(v)["segments"]}
    assert set(folders) == named and len(engine.store._versions()) == store_module.KEPT


def test_a_small_refresh_writes_little(spark, tmp_path):
    """What a refresh of one file writes doesn't depend on the corpus."""
    written = {}
    for n in (8, 240):
        rng = random.Random(5)
        files = dict(source(k, rng) for k in range(n))
        engine = Engine(spark, str(tmp_path / f"d{n}"), files=table(spark, files))
        engine.refresh()
        files["pkg/m0.py"] = "def alpha():\n    return 1\n"
        engine.table = table(spark, files)
        assert engine.refresh()["updated"] == 1
        first, last = engine.store.manifest()["segments"]
        assert last["marks"] == 1
        written[n] = last["bytes"], first["bytes"]
    assert written[240][1] > 1.5 * written[8][1] and written[240][0] <= written[8][0] * 1.02


def test_nothing_changed_writes_no_segment(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "d"), files=table(spark, {"a.md": "alpha", "b.py": "x = 1\n"}))
    first, again = engine.refresh(), None
    folders = engine.store._names(f"{engine.store.root}/segments")
    time.sleep(0.01)
    again = engine.refresh()
    assert (again["added"], again["updated"], again["removed"]) == (0, 0, 0) and again["timestamp"] > first["timestamp"]
    assert engine.store._names(f"{engine.store.root}/segments") == folders


def test_calls_after_a_refresh_open_no_source(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo"
    rng = random.Random(3)
    for path, text in (source(k, rng) for k in range(16)):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    engine = Engine(spark, str(tmp_path / "data"), root=str(root))
    live = {n: sorted(map(str, df.collect())) for n, df in (("outline", engine.outline()), ("refs", engine.references(WORDS, top_k=50)), ("defs", engine.find_definition(WORDS)), ("profile", engine.profile_references(WORDS)))}
    engine.refresh()
    root.rename(tmp_path / "elsewhere")
    from gleanery.sources import corpus

    def refuse(*_):
        raise AssertionError("a source was opened")

    for name in ("list_directory", "read_files", "one_file"):
        monkeypatch.setattr(corpus, name, refuse)
    stored = {n: sorted(map(str, df.collect())) for n, df in (("outline", engine.outline()), ("refs", engine.references(WORDS, top_k=50)), ("defs", engine.find_definition(WORDS)), ("profile", engine.profile_references(WORDS)))}
    assert stored == live and all(live.values())
    bundle = engine.bundle("alpha load store", 3, 40)
    assert bundle["selections"].count() > 0


def corpus(spark, n=400):
    """Sorted paths: some words are in few neighbouring files only, some everywhere."""
    rng = random.Random(7)
    files = {f"d{k // 50}/f{k:04d}.md": " ".join(["common"] * rng.randint(1, 9) + [f"topic{k // 40}"] * rng.randint(0, 5) + rng.choices(WORDS, k=rng.randint(3, 40))) for k in range(n)}
    files |= {f"same/{k}.md": "twin alpha" for k in range(30)}
    return files


QUERIES = ["topic3 common", "topic7", "common", "alpha beta topic1 topic9", "twin alpha", "absent", "", "delta widget core common"]


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """An index of two segments, some of whose rows are dead."""
    files, before, store_module.RANGE_BITS = corpus(spark), store_module.RANGE_BITS, 4
    engine = Engine(spark, str(tmp_path_factory.mktemp("mixed")), files=table(spark, files))
    engine.refresh()
    for k in range(0, 400, 37):
        files[f"d{k // 50}/f{k:04d}.md"] = "alpha topic3 " * (k % 5)
    del files["same/3.md"]
    engine.table = table(spark, files)
    engine.refresh()
    store_module.RANGE_BITS = before
    return engine


@pytest.mark.parametrize("prefix,glob", [(None, None), ("d3", None), (None, "*/f00?[1-5].md"), ("same", None), ("none", None)])
def test_blocks_equal_plain_bm25(spark, mixed, prefix, glob):
    engine = mixed
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    docs = search.filtered(engine.store.read("chunks"), glob, prefix)
    for k in (1, 20):
        want = search.bm25(docs, queries, k).select("query_id", "path", "start_line", "score", "matched_terms", "rank", "snippet")
        got = engine.search(QUERIES, top_k=k, file_glob=glob, path_prefix=prefix).select("query_id", "path", "start_line", "score", "matched_terms", "rank", "snippet")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_blocks_are_skipped_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "RANGE_BITS", 4)
    engine = Engine(spark, str(tmp_path / "d"), files=table(spark, corpus(spark, 1200)))
    engine.refresh()
    report = {r.query_id: r for r in engine.search_report(QUERIES, top_k=3).collect()}
    assert report[0].scored_ranges < 0.5 * report[0].ranges and report[0].ranges > 30
    assert report[1].scored_ranges <= report[1].ranges and 5 not in report
    found = engine.store.read("blocks", live=False)
    assert found.agg(F.max(F.size("docs"))).first()[0] <= 16 and found.where("term = 'common'").count() >= 1200 / 16
    wrong = found.where("n <> size(docs) or max_tf <> array_max(transform(docs, x -> x.tf)) or min_dl <> array_min(transform(docs, x -> x.dl))")
    assert wrong.isEmpty()


def test_a_large_table_is_dealt_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "SMALL_BYTES", 1)
    store = Store(spark, str(tmp_path / "s"), {"blocks": blocks.build})
    segment = store.begin()
    monkeypatch.setattr(store, "_bytes", lambda path: 2)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if it were large
    rows = spark.range(4000).selectExpr("'hot' as term", "id as range", "id as n").union(spark.range(40).selectExpr("'cold' as term", "id as range", "id as n")).repartition(5)
    made = store.put(segment, "blocks", rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = made.groupBy(F.input_file_name().alias("f")).agg(F.min(F.struct("term", "range")).alias("low"), F.max(F.struct("term", "range")).alias("high"), F.count("*").alias("n")).orderBy("low").collect()
    assert len(parts) > 1 and all(a.high < b.low for a, b in zip(parts, parts[1:])) and max(p.n for p in parts) < 3000  # a term in several files
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, rows.collect())) and store._names(f"{store.root}/segments/{segment}") == ["blocks"]


def test_names_equal_the_plain_join(spark):
    rng = random.Random(11)
    files = dict(source(k, rng) for k in range(40)) | {"a/x.go": "func f() {\n\tnew alpha\n\ta.load(1)\n\tload\n}\n", "a/y.rs": "use core::load;\nimpl load for X {}\n", "a/odd.ts": "x = 'un closed"}
    from gleanery.functions import text as T
    from gleanery.operators.outline import language

    plain = table(spark, files)
    texts = plain.withColumn("language", language("path")).withColumn("masked", F.when(F.col("language") != "python", T.masked("text")))
    symbols = spark.createDataFrame([(w,) for w in [*WORDS, "a.load", "core::load", " ", "x..", "Base"]], "symbol string")
    code = plain.where(~language("path").isin("python", "lexical"))
    want = sorted(map(str, references.lexical_references(code, symbols).collect()))
    assert sorted(map(str, names.lexical_references(names.build(texts), texts, symbols).collect())) == want and len(want) > 20


def test_a_prefix_opens_few_files(spark, tmp_path, monkeypatch):
    """Large tables lie in files of neighbouring paths, whose bounds tell which of them a prefix needs."""
    monkeypatch.setattr(Store, "_bytes", lambda self, path: store_module.SMALL_BYTES + 1)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if it were large
    files = {f"d{k // 10:02d}/f{k:03d}.md": f"alpha w{k} beta" for k in range(200)} | {"d1/x.md": "alpha d1"}
    engine = Engine(spark, str(tmp_path / "d"), files=table(spark, files))
    engine.refresh()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    every = engine.store.read("chunks").inputFiles()
    for prefix, n in (("d03", 10), ("d1", 101), ("d19/f199", 1), ("zz", 0), ("a", 0)):
        some = engine.store.read("chunks", prefix=prefix)
        assert some.where(F.col("path").startswith(prefix)).count() == n
        if n <= 10:
            assert len(some.inputFiles()) <= 2 < len(every)
    hits = engine.search("alpha", top_k=50, path_prefix="d03").collect()
    assert len(hits) == 10 and all(r.path.startswith("d03/") for r in hits)


def test_stale_hits_are_marked(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    for name in "abc":
        (root / f"{name}.md").write_text("alpha beta")
    engine = Engine(spark, str(tmp_path / "data"), root=str(root))
    engine.refresh()
    (root / "b.md").write_text("alpha beta gamma")
    (root / "c.md").unlink()
    hits = engine.search("alpha")
    assert {r.path: r.stale for r in engine.marked_stale(hits).collect()} == {"a.md": False, "b.md": True, "c.md": True}
    rows = Engine(spark, str(tmp_path / "other"), files=table(spark, {"a.md": "alpha", "b.md": "alpha"}))
    rows.refresh()
    rows.table = table(spark, {"a.md": "alpha", "b.md": "alphb"})
    assert {r.path: r.stale for r in rows.marked_stale(rows.search("alpha")).collect()} == {"a.md": False, "b.md": True}


def test_a_reader_that_stumbles_affects_its_file_only(spark, monkeypatch):
    from gleanery.operators import outline

    found = outline.outline(table(spark, {"a.go": "package p\n\nfunc f() {\n}\n", "b.py": "def g(" + "(" * 5000, "c.py": "def h():\n    pass\n"}))
    assert {r.path for r in found.collect()} == {"a.go", "c.py"}


def test_a_refresh_shuffles_no_text_that_stays(spark, tmp_path):
    """Of a table, only texts that are opened are shuffled, and none if all are."""
    rng = random.Random(1)
    files = {f"d/{k:03d}.md": "\n".join(f"{rng.getrandbits(256):x}" for _ in range(300)) for k in range(200)}
    engine = Engine(spark, str(tmp_path / "d"), files=table(spark, files))
    sc, before = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def shuffled(name: str) -> int:
        sc.setJobGroup(name, "")
        engine.refresh()
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        store = sc._jsc.sc().statusStore()
        return sum(store.lastStageAttempt(s).shuffleWriteBytes() for s in {s for j in sc.statusTracker().getJobIdsForGroup(name) for s in sc.statusTracker().getJobInfo(j).stageIds})

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first = shuffled("first refresh")
        files["d/007.md"] = "alpha beta\n"
        engine.table = table(spark, files)
        again = shuffled("second refresh")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        sc._jsc.sc().clearJobGroup()
    size = sum(map(len, files.values()))
    assert first < size / 4 and again < size / 8
    assert [r.path for r in engine.search("alpha").collect()] == ["d/007.md"]


def test_texts_are_split_once_for_chunks(spark):
    from gleanery.operators import chunking

    rows = spark.createDataFrame([("p", "a\nb\nc\nd\ne"), ("q", ""), ("r", None)], "path string, text string")
    found = chunking.chunks(rows, 3, 1)
    assert sorted((r.path, r.start_line, r.end_line, r.text) for r in found.collect()) == [("p", 1, 3, "a\nb\nc"), ("p", 3, 5, "c\nd\ne")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1
