import math

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleanery.engine import Engine
from gleanery.errors import InvalidArgument
from gleanery.functions import text as T
from gleanery.operators import blocks, chunking, discovery, fusion, search, semantic
from gleanery.plans import bundle


def docs(spark, *rows):
    return spark.createDataFrame([(str(i), p, 1, len(t.splitlines()), t) for i, (p, t) in enumerate(rows)], "chunk_id string, path string, start_line int, end_line int, text string")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_chunk_ranges(spark):
    rows = spark.createDataFrame([("a", "\n".join(map(str, range(500)))), ("b", ""), ("c", "x\n")], "path string, text string")
    got = sorted((r.path, r.start_line, r.end_line) for r in chunking.chunks(rows).collect())
    assert got == [("a", 1, 200), ("a", 171, 370), ("a", 341, 500), ("c", 1, 1)]
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(InvalidArgument):
            chunking.chunks(rows, *bad)
    for n in range(1, 40):
        text = spark.createDataFrame([("p", "\n".join(["x"] * n))], "path string, text string")
        want, at = [], 1
        while True:
            want.append((at, min(at + 9, n)))
            if at + 9 >= n:
                break
            at += 7
        assert sorted((r.start_line, r.end_line) for r in chunking.chunks(text, 10, 3).collect()) == want


def plain_bm25(texts, query):
    import re

    words = [[t.lower() for t in re.findall(r"[A-Za-z0-9_]+", x)] for x in texts]
    avg, out = sum(map(len, words)) / len(words), {}
    for i, w in enumerate(words):
        s = 0.0
        for t in sorted(set(re.findall(r"[a-z0-9_]+", query.lower()))):
            df, tf = sum(t in x for x in words), w.count(t)
            if tf:
                s += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg)))
        if s > 0:
            out[i] = s
    return out


def test_bm25_against_plain_loops(spark):
    import random

    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("alpha beta gamma delta Keyword x_1".split()) for _ in range(rnd.randrange(12))) for _ in range(40)]
    corpus = docs(spark, *((f"p{i:02}", t) for i, t in enumerate(texts)))
    got = {(r.query_id, int(r.chunk_id)): r.score for r in search.bm25(corpus, ask(spark, "alpha keyword", "X_1 nothing", "zzz"), 100).collect()}
    want = {(q, i): s for q, text in enumerate(["alpha keyword", "x_1 nothing"]) for i, s in plain_bm25(texts, text).items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_ties_filters_and_limits(spark):
    corpus = docs(spark, ("b/same.py", "alpha"), ("a/same.py", "alpha"), ("docs/x.md", "alpha beta"))
    assert [r.path for r in search.bm25(corpus, ask(spark, "alpha"), 2).orderBy("rank").collect()] == ["a/same.py", "b/same.py"]
    assert [r.path for r in search.filtered(corpus, path_prefix="docs/").collect()] == ["docs/x.md"]
    assert {r.path for r in search.filtered(corpus, file_glob="?/*.py").collect()} == {"a/same.py", "b/same.py"}
    assert search.bm25(corpus, ask(spark, ""), 5).collect() == []
    assert search.bm25(corpus.limit(0), ask(spark, "alpha"), 5).collect() == []


def test_cosine_and_pooling(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(0, [3.0, 0.0])], "query_id long, query_vector array<double>")
    assert [(r.id, r.score) for r in semantic.nearest(v, q, 3).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (3, 0.0)]
    with pytest.raises(Exception, match="size"):
        semantic.nearest(v, spark.createDataFrame([(0, [1.0])], q.schema), 1).collect()
    pooled = semantic.mean_pool(v.withColumn("g", F.col("id") % 2), "g").collect()
    assert {r.g: [round(x, 6) for x in r.vector] for r in pooled} == {1: [1.0, 0.0], 0: [0.0, 1.0]}


def test_vector_refresh(spark):
    stored = spark.createDataFrame([("keep", [1.0]), ("stale", [2.0])], "chunk_id string, vector array<double>")
    chunks = spark.createDataFrame([("keep", "a"), ("new", "b"), ("bad", "fail")], "chunk_id string, text string")
    plan = {r.chunk_id: r.action for r in semantic.refresh_plan(stored, chunks).collect()}
    assert plan == {"keep": "reuse", "stale": "remove", "new": "embed", "bad": "embed"}

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t == "fail" else [float(len(t))])

    assert {r.chunk_id: list(r.vector) for r in semantic.refreshed(stored, chunks, embed).collect()} == {"keep": [1.0], "new": [1.0]}


def test_fusion(spark):
    schema = "query_id long, path string, start_line int, end_line int, snippet string, score double, matched_terms array<string>, rank int"
    a = spark.createDataFrame([(0, "x", 1, 2, "sx", 9.0, ["b"], 1), (0, "y", 1, 2, "sy", 8.0, ["c"], 2)], schema)
    b = spark.createDataFrame([(0, "y", 1, 2, "", 0.9, ["a"], 1), (0, "z", 1, 2, "", 0.8, [], 2)], schema)
    rows = fusion.fuse(a, b, 10).orderBy("rank").collect()
    assert [r.path for r in rows] == ["y", "x", "z"] and rows[0].score == 1 / 61 + 1 / 62 and rows[0].snippet == "sy" and rows[0].matched_terms == ["a", "c"]


def test_records_and_delta(spark):
    files = spark.createDataFrame([("a.py", 1, 1, bytearray(b"x")), ("b.py", 3, 1, bytearray(b"\x00\x01\x02")), ("c.py", 1, 2, bytearray(b"z")), ("cut.py", 4097, 1, bytearray(b"a" * 4095 + "é".encode()))], "path string, size long, mtime_ns long, content binary")
    first = discovery.file_records(files)
    assert {r.path for r in first.collect()} == {"a.py", "c.py"}
    old = spark.createDataFrame([("a.py", 1, 1, "kept"), ("b.py", 3, 1, "old"), ("c.py", 1, 1, "h"), ("gone.py", 1, 1, "g")], "path string, size long, mtime_ns long, content_hash string")
    again = {r.path: r.content_hash for r in discovery.file_records(files, old).collect()}
    assert again["a.py"] == "kept" and again["b.py"] == "old" and len(again["c.py"]) == 64
    got = {r.path: r.change for r in discovery.delta(old, discovery.file_records(files, old)).collect()}
    assert got == {"a.py": "unchanged", "b.py": "unchanged", "c.py": "updated", "gone.py": "removed"}


def test_keyword_budget(spark):
    prompts = spark.createDataFrame([(1, "Fix the parser of service.run and run it in CI for parser tests again now please")], "prompt_id long, prompt string")
    rows = bundle.queries(prompts, 50).orderBy("query_index").collect()
    assert [r.query for r in rows[1:]] == ["fix", "the", "parser", "service", "run", "and", "for", "tests"] and [r.k for r in rows[:2]] == [50, 12]
    assert bundle.queries(prompts, 20).where("query_index = 2").first().k == 5 and bundle.queries(prompts, 4).where("query_index = 3").first().k == 4


def ranking_case(spark):
    prompts = spark.createDataFrame([(0, "service run parser")], "prompt_id long, prompt string")
    raw = [(0, "service run parser", "src/service.py", 1, 12, 2.5, ["run", "service"]), (0, "service run parser", "src/app.py", 10, 20, 1.6, ["parser"]), (1, "service", "src/service.py", 1, 12, 2.4, ["service"]), (2, "run", "src/app.py", 10, 20, 1.5, ["run"]), (3, "parser", "src/utils.py", 3, 8, 1.2, ["parser"])]
    hits = spark.createDataFrame([(0, *r) for r in raw], "prompt_id long, query_index int, source_query string, path string, start_line int, end_line int, score double, matched_terms array<string>")
    symbols = spark.createDataFrame([("src/service.py", "class", "Service", 1, 12), ("src/service.py", "method", "Service.run", 4, 7), ("src/app.py", "function", "use_service", 11, 18), ("src/app.py", " ", "blank", 12, 12), ("src/app.py", "f", "wrong", 14, 13)], "path string, kind string, name string, start_line int, end_line int")
    return prompts, hits, symbols


def test_bundle_ranking_and_budget(spark):
    prompts, hits, symbols = ranking_case(spark)
    none = spark.createDataFrame([], "symbol string, path string, line int")
    ranked = bundle.candidates(hits, prompts, symbols, none)
    budgets = prompts.select("prompt_id", F.lit(2).alias("max_files"), F.lit(16).alias("max_total_lines"))
    judged = bundle.verdicts(ranked, budgets)
    rows = judged.orderBy("rank_position").collect()
    got = [(r.path, r.start_line, r.end_line, r.definition_match, r.reference_count_in_range, r.min_definition_distance, r.path_name_relevance, r.score, r.range_size_penalty, r.verdict) for r in rows]
    assert got == [
        ("src/service.py", 4, 7, True, 0, 10**9, 1, 2.5, 4, "selected"),
        ("src/app.py", 11, 18, False, 0, 10**9, 0, 1.6, 8, "selected"),
        ("src/utils.py", 3, 8, False, 0, 10**9, 0, 1.2, 6, "file_budget"),
    ]
    sums = bundle.totals(judged).first()
    assert (sums.selected_files, sums.selected_lines, sums.truncated, sums.file_budget, sums.other) == (2, 12, True, 1, 0)
    assert [r.note for r in bundle.notes(judged).collect()] == ["skipped_file_budget:src/utils.py:3-8"]
    corpus = spark.createDataFrame([("src/service.py", "\n".join(f"l{i}" for i in range(1, 13))), ("src/app.py", "x\n" * 20)], "path string, text string")
    chosen = bundle.explained(judged, corpus).orderBy("selection_index").collect()
    assert chosen[0].excerpt == "l4\nl5\nl6\nl7"
    assert chosen[0].rationale == "Selected from query 'service run parser' with score 2.500000; matched_terms=run, service. aligned_symbol=Service.run."
    assert chosen[0].why_selected.matched_signals == ["search_score", "matched_terms", "definition_match", "aligned_symbol"]
    ids = bundle.bundle_ids(prompts, bundle.totals(judged), bundle.explained(judged, corpus)).first()
    assert ids.prompt_fingerprint == "893d18ab6d929b3703bc4184d82d3bb00267ece8b38af5c0c66ea2a27e5e069c" and len(ids.bundle_id) == 64


def test_references_nearby_outrank_scores(spark):
    prompts = spark.createDataFrame([(0, "zzz")], "prompt_id long, prompt string")
    hits = spark.createDataFrame([(0, 0, "zzz", "a.py", 10, 12, 5.0, []), (0, 0, "zzz", "b.py", 30, 32, 1.0, [])], "prompt_id long, query_index int, source_query string, path string, start_line int, end_line int, score double, matched_terms array<string>")
    symbols = spark.createDataFrame([("a.py", "f", "one", 10, 12), ("b.py", "f", "two", 30, 32)], "path string, kind string, name string, start_line int, end_line int")
    refs = spark.createDataFrame([("two", "b.py", 31), ("two", "b.py", 31), ("one", "a.py", 20), ("one", "b.py", 11)], "symbol string, path string, line int")
    rows = bundle.candidates(hits, prompts, symbols, refs).orderBy("rank_position").collect()
    assert [(r.path, r.reference_count_in_range, r.min_definition_distance) for r in rows] == [("b.py", 1, 0), ("a.py", 0, 8)]


def test_a_skip_does_not_end_the_budget(spark):
    rows = [(0, 1, "a", 1, 4), (0, 2, "b", 1, 9), (0, 3, "a", 5, 8), (0, 4, "c", 1, 1), (0, 5, "d", 3, 2)]
    cand = spark.createDataFrame(rows, "prompt_id long, rank_position int, path string, start_line int, end_line int")
    budget = spark.createDataFrame([(0, 2, 9)], "prompt_id long, max_files int, max_total_lines int")
    got = [r.verdict for r in bundle.verdicts(cand, budget).orderBy("rank_position").collect()]
    assert got == ["selected", "line_budget", "selected", "selected", "zero_lines"]


def test_wanted_words_of_bytes_are_the_tokens_of_texts(spark):
    texts = ["Alpha alpha_1 BETA", None, "", "Kelvin Käse beta BETA İx", "x" * 50 + " alpha " * 3, "퟿\U0001f600beta"]
    place = {t: i for i, t in enumerate(["alpha", "beta", "k", "se", "x", "elvin"])}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", T.tokens("text").alias("words")).collect()
    want = {(r.i, place[w]): r.words.count(w) for r in rows for w in r.words or [] if w in place}
    row, code, tf, dl = search._counted(pa.array(texts), {t.encode(): i for t, i in place.items()})
    assert dict(zip(zip(row.tolist(), code.tolist(), strict=True), tf.tolist(), strict=True)) == want
    assert dl.tolist() == [len(r.words or []) for r in sorted(rows)]


def test_a_kept_document_is_held_once_for_all_queries(spark, monkeypatch):
    """Between two batches a task of 400 queries with 20 hits each holds no Arrow memory of its own."""
    docs = spark.range(200).select(F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("p/"), "id").alias("path"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.concat(F.repeat(F.lit("alpha "), F.col("id").cast("int") % 7 + 1), F.lit("ü" * 300)).alias("text")).coalesce(1)
    run, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: (run.append((self, f)), plain(self, f, schema))[1])
    hits = search.bm25(docs, spark.range(400).select(F.col("id").alias("query_id"), F.lit("alpha").alias("query")), 20)
    assert [len(r.snippet) for r in hits.collect()] == [300] * 8000
    read, score = run[-1]
    batches, held = read.toArrow().combine_chunks().to_batches(), []

    def given():
        before = pa.total_allocated_bytes()
        yield batches[0]
        held.append(pa.total_allocated_bytes() - before)

    assert sum(b.num_rows for b in score(given())) == 8000 and held[0] < 1 << 20


def test_postings_are_counted_in_place_and_repeated_keys_added_up(spark):
    docs = spark.createDataFrame([("a", "x x Y"), ("b", "y z"), ("b", "y"), ("c", None), ("d", "")], "chunk_id string, text string")
    found = search.postings(docs)
    assert sorted((r.chunk_id, r.term, r.tf) for r in found.collect()) == [("a", "x", 2), ("a", "y", 1), ("b", "y", 2), ("b", "z", 1)]
    assert {r.dl for r in found.where("chunk_id = 'a'").collect()} == {3}
    wanted = spark.createDataFrame([("y",)], "term string")
    assert sorted((r.chunk_id, r.tf) for r in search.postings(docs, wanted=wanted).collect()) == [("a", 1), ("b", 2)]
    assert "Generate" not in found._jdf.queryExecution().toString()  # no row for each word before a shuffle


def test_blocks_are_made_in_place(spark):
    chunks = spark.createDataFrame([(0, 0, 3, "x x Y"), (1, 0, 0, "-"), (2, 0, 1, "y"), (300, 1, 1, "y")], "doc long, range long, dl int, text string")
    found = blocks.build(chunks.coalesce(1))
    assert sorted((r.term, r.range, r.n, r.max_tf, r.min_dl, [tuple(d) for d in r.docs]) for r in found.collect()) == [("x", 0, 1, 2, 3, [(0, 2, 3)]), ("y", 0, 2, 1, 1, [(0, 1, 3), (2, 1, 1)]), ("y", 1, 1, 1, 1, [(300, 1, 1)])]
    assert "Generate" not in found._jdf.queryExecution().toString()  # no row for each word before a shuffle


def test_a_paragraph_is_named_by_its_first_token_alone(spark):
    from gleanery.plans.queries import _paragraphs

    found = _paragraphs(spark.createDataFrame([("p", "- ÄB c\nd\n\n\n...\n\n\n\nE_1 f"), ("q", None)], "path string, text string"))
    assert sorted((r.path, r.name, r.start_line, r.end_line) for r in found.collect()) == [("p", "b", 1, 4), ("p", "e_1", 9, 9)]
    assert "regexp_extract_all" not in found._jdf.queryExecution().toString()


def test_searches_shuffle_a_posting_once_and_not_for_each_query(spark, tmp_path):
    """What a search of the index shuffles doesn't grow with its queries times the documents that they meet."""
    engine = Engine(spark, str(tmp_path / "d"), files=spark.createDataFrame([(f"d/{i:04d}.md", f"alpha beta gamma delta w{i % 7}") for i in range(3000)], "path string, text string"))
    engine.refresh()

    def shuffled(n: int) -> int:
        spark.sparkContext.setJobGroup(f"search {n}", "")
        asked = spark.createDataFrame([(i, f"alpha beta gamma delta w{i % 7}") for i in range(n)], "query_id long, query string")
        assert engine.search(asked, top_k=5).count() == 5 * n
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
        stages = {s for j in tracker.getJobIdsForGroup(f"search {n}") for s in tracker.getJobInfo(j).stageIds}
        return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)

    try:
        assert shuffled(40) < 15_000  # 40 * 3000 scores, five times as many weights
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()


def test_a_range_in_two_tasks_is_searched_as_one(spark):
    rows = [(i, 0, 2 + i % 3, f"c{i}", f"p{i:02d}", 1, 1, "", "x y" + " x" * (i % 3)) for i in range(40)]
    chunks = spark.createDataFrame(rows, "doc long, range long, dl int, chunk_id string, path string, start_line int, end_line int, snippet string, text string").withColumn("seg", F.lit(1).cast("long"))
    queries = spark.createDataFrame([(7, "x y"), (8, "z")], "query_id long, query string")
    found = [blocks.Search(blocks.build(c).withColumn("seg", F.lit(1).cast("long")), chunks, queries, 9, seg="seg").hits() for c in (chunks.coalesce(1), chunks.repartition(3, "doc").sortWithinPartitions("doc"))]
    whole, parts = (sorted((r["rank"], r.path, r.score, tuple(r.matched_terms)) for r in f.collect()) for f in found)
    assert whole == parts and len(whole) == 9 and whole[0][3] == ("x", "y")
