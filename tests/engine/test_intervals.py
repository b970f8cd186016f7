import random

from pyspark.sql import functions as F

from gleanery.operators import intervals
from gleanery.plans import bundle


def test_blocks_make_up_ranges(spark):
    rows = [(a, b) for a in range(1, 40) for b in range(a - 1, 40)] + [(1, 1 << 30), ((1 << 20) + 1, (1 << 31) - 2), (2**31 - 2, 2**31 - 2)]
    df = spark.createDataFrame(rows, "a int, b int")
    for r in df.select("a", "b", intervals.covering(F.col("a"), F.col("b")).alias("x"), intervals.containing(F.col("a")).alias("y")).collect():
        whole = sorted((x.at << x.level, (x.at + 1) << x.level) for x in r.x or [])
        assert len(whole) <= 64 and (not whole) == (r.b < r.a)
        if whole:
            assert whole[0][0] == r.a and whole[-1][1] == r.b + 1 and all(p[1] == q[0] for p, q in zip(whole, whole[1:]))
        assert [(y.level, y.at) for y in r.y] == [(k, r.a >> k) for k in range(r.a.bit_length())]


def made(seed, n_hits=120, n_symbols=80, lines=60):
    rng = random.Random(seed)
    span = lambda: sorted((rng.randint(1, lines), rng.randint(1, lines)))
    hits = [(f"h{i}", rng.choice("pqr"), *span(), i) for i in range(n_hits)]
    symbols = [(rng.choice("pqs"), *span(), rng.choice(["n1", "n2", "n3", " ", None]), rng.choice(["function", "class", None])) for _ in range(n_symbols)]
    symbols += [("p", 5, 4, "odd", "class"), ("p", 0, 3, "zero", "class"), ("p", None, 3, "null", "class")]
    return hits, symbols


def test_align_equals_plain_loops(spark):
    for seed in (1, 2):
        hits, symbols = made(seed)
        got = {r.hit_id: (r.start_line, r.end_line, r.aligned_symbol, r.extra) for r in bundle.align(spark.createDataFrame(hits, "hit_id string, path string, start_line int, end_line int, extra int"), spark.createDataFrame(symbols, "path string, start_line int, end_line int, name string, kind string")).collect()}
        assert len(got) == len(hits)
        for h, path, a, b, extra in hits:
            met = [(e - s, s, e, n, k) for p, s, e, n, k in symbols if p == path and n and n.strip() and k and s and e >= s >= 1 and e >= a and s <= b]
            want = min(met, default=None)
            assert got[h] == ((want[1], want[2], want[3], extra) if want else (a, b, None, extra))


def test_proximity_equals_plain_loops(spark):
    rng = random.Random(4)
    hits = [(f"h{i}", rng.choice("pq"), *sorted((rng.randint(1, 50), rng.randint(1, 50))), rng.choice(["n1", "n2", None])) for i in range(150)]
    refs = [(rng.choice(["n1", "n2"]), rng.choice("ps"), rng.choice([None, 0, *range(1, 50)])) for _ in range(60)]
    got = {r.hit_id: (r.reference_count_in_range, r.min_definition_distance) for r in bundle.proximity(spark.createDataFrame(hits, "hit_id string, path string, start_line int, end_line int, aligned_symbol string"), spark.createDataFrame(refs, "symbol string, path string, line int")).collect()}
    for h, path, a, b, name in hits:
        own = {x for s, p, x in refs if (s, p) == (name, path) and x}
        want = sum(a <= x <= b for x in own), min((max(a - x, x - b, 0) for x in own), default=bundle.FAR)
        assert got[h] == want, h


def test_rows_stay_linear_in_one_large_file(spark):
    """20,000 hits and as many nested symbols on one path: rows that joins make are a small multiple of these, not 4 * 10^8."""
    n = 20_000
    hits = spark.range(n).selectExpr("id as hit_id", "'p' as path", "cast(id % 9000 + 1 as int) as start_line", "cast(id % 9000 + 201 as int) as end_line")
    symbols = spark.range(n).selectExpr("'p' as path", "cast(1 + id % 97 as int) as start_line", "cast(9000 + id as int) as end_line", "concat('s', id) as name", "'class' as kind")
    out = bundle.align(hits, symbols)
    assert out.where("aligned_symbol is null").count() == 0
    refs = spark.range(n).selectExpr("concat('s', id % 3) as symbol", "'p' as path", "cast(id as int) as line")
    near = bundle.proximity(hits.withColumn("aligned_symbol", F.lit("s1")), refs)
    rows = near.collect()
    assert len(rows) == n and {r.reference_count_in_range for r in rows} <= {66, 67}

    def made(df, name):
        total, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                todo.append(node.executedPlan())
                continue
            if "QueryStage" in node.nodeName():
                todo.append(node.plan())
                continue
            if name in node.nodeName() and node.metrics().contains("numOutputRows"):
                total += node.metrics().apply("numOutputRows").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return total

    out.collect()
    assert 0 < made(out, "Join") < 60 * n and 0 < made(near, "Join") < 5 * n
