from collections import defaultdict

from gleanery.llm import mixing


def water(sizes, weights, total, epochs=2):
    clamped = set()
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(epochs * sizes[s] for s in clamped)
        level = left / sum(weights[s] for s in free) if free else 0
        over = {s for s in free if epochs * sizes[s] <= level * weights[s]}
        if not over:
            return {s: epochs * sizes[s] if s in clamped else level * weights[s] for s in sizes}
        clamped |= over


def test_targets_and_taken(docs):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), "en", ["b", "a", None, "c"][min(i % 9, 3)]) for i in range(400)]
    rows += [(1000, None, "en", "a"), (1001, "", "en", "d"), (None, "x y z", None, "b"), (None, "x y z", None, "b")]
    got = mixing.mix(docs(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    weights = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}
    want = water(sizes, weights, 1.5 * sum(sizes.values()))
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6 and abs(taken[s] - want[s]) <= 12, s
    again = mixing.mix(docs(rows).repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_repeated_rows_keep_their_columns(docs):
    rows = [(1, "a b c", "en", "x"), (2, "d e f", "en", "x"), (3, "", "en", "x"), (4, None, "en", None)]
    table = docs(rows)
    out = mixing.repeated(table)
    assert out.columns == table.columns
    assert sum(len((r.text or "").split()) for r in out.collect()) in (9,)
    assert {r.doc_id for r in out.collect()} >= {3, 4}


def test_empty(docs):
    assert mixing.mix(docs([])).collect() == []
    assert mixing.mix(docs([(1, None), (2, "")])).count() == 2
