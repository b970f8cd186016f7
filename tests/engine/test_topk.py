import random
from collections import defaultdict

import pytest

from gleanery.operators import outline, references, topk
from gleanery.operators.topk import first_with_totals

SCHEMA = "key string, a string, b int, more double"


def made(seed, n=3000):
    random.seed(seed)
    key = lambda: random.choice(["hot"] * 12 + ["cold", "Straße", "x", "", None, *(f"k{i}" for i in range(40))])
    return [(key(), random.choice(["p", "q/é", "q/\U0001f600", "q/￿", None]), random.choice([None, 1, 2, 3]), float(i)) for i in range(n)]


def brute(rows, k):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(((r[1] is not None, (r[1] or "").encode(), r[2] is not None, r[2] or 0), r))
    out = []
    for key, own in by.items():
        own.sort(key=lambda x: x[0])
        out += [(key, o[1], o[2], i + 1, len(own)) for i, (_, o) in enumerate(own[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k,held,salts", [(1, 100_000, 16), (5, 10, 3), (50, 100_000, 1), (10_000, 7, 16)])
def test_against_plain_loops(spark, monkeypatch, k, held, salts):
    monkeypatch.setattr(topk, "HELD", held)
    monkeypatch.setattr(topk, "SALTS", salts)
    rows = made(k)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
        found = first_with_totals(spark.createDataFrame(rows, SCHEMA).repartition(7), "key", ["a", "b"], k).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(((r.key, r.a, r.b, r["rank"], r.total) for r in found), key=str) == brute(rows, k)


def test_empty(spark):
    assert first_with_totals(spark.createDataFrame([], SCHEMA), "key", ["a"], 3).collect() == []


def test_a_hot_symbol_is_never_whole_in_a_task(spark):
    """A symbol with nearly all rows: k rows and a count from each task, and no window in the plan."""
    found = spark.range(0, 200_000, 1, 8).selectExpr("if(id % 1000 = 0, 'rare', 'self') as symbol", "concat('f', id % 977) as path", "cast(id as int) as line", "'call' as kind", "'e' as evidence", "'lexical' as strategy", "'low' as confidence")
    out = references.limited(found, 50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 3
    rows = out.collect()
    totals = {(r.symbol, r.total_candidates, r.truncated) for r in rows}
    assert totals == {("self", 199_800, True), ("rare", 200, True)} and len(rows) == 100
    first = sorted((f"f{i % 977}", i) for i in range(200_000) if i % 1000)[:50]
    assert [(r.path, r.line) for r in sorted(rows, key=lambda r: (r.symbol, r["rank"])) if r.symbol == "self"] == first
    metrics = {}

    def walk(node):  # rows that each exchange has written
        name = node.nodeName()
        if name in ("AdaptiveSparkPlan",):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name == "Exchange":
            metrics[len(metrics)] = node.metrics().apply("shuffleRecordsWritten").value()
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(out._jdf.queryExecution().executedPlan())
    assert len(metrics) == 2 and all(n <= 8 * 2 * 50 * topk.SALTS for n in metrics.values())


def test_definitions_keep_their_totals(spark):
    symbols = spark.createDataFrame([(f"p{i % 7}", "python", "class", "A.load" if i % 2 else "load", None, i + 1, i + 2, None, None, "class", False, None) for i in range(300)], outline.SYMBOLS)
    rows = outline.definitions(symbols, spark.createDataFrame([("load",), ("none",)], "symbol string"), 10).collect()
    assert len(rows) == 10 and {r.total_candidates for r in rows} == {300} and all(r.truncated for r in rows)
    assert [(r.path, r.start_line) for r in sorted(rows, key=lambda r: r["rank"])] == sorted((f"p{i % 7}", i + 1) for i in range(300))[:10]
