import random

import xxhash
from hypothesis import given
from hypothesis import strategies as st

from gleanery.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    """doc_id -> smallest doc_id reachable, by flooding all pairs."""
    ids = sorted(prints)
    seen = {}
    for start in ids:
        if start in seen:
            continue
        todo, seen[start] = [start], start
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in seen and bin(prints[x] ^ prints[y]).count("1") <= radius:
                    seen[y] = start
                    todo.append(y)
    return seen


@given(st.sets(st.integers(0, 63), max_size=2))
def test_every_pair_within_the_radius_meets_in_a_table(bits):
    diff = sum(1 << b for b in bits)
    assert any(m % (1 << 64) & diff == 0 for m in simhash.masks())


def test_edges_and_ties(docs):
    long = " ".join(f"w{i % 977}" for i in range(90_000))
    rows = [(5, "a b c d e"), (3, "A b  c\td e"), (3, "A b c d e"), (9, None), (8, ""), (7, " \n "), (None, "x y"), (None, "x y"), (11, long), (12, long), (20, "ß É ss"), (21, "one")]
    got = {}
    for r in simhash.near_duplicates(docs(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.fingerprint % (1 << 64), r.component_id))
    assert sorted(got[5] + got[3]) == [(brute_print("a b c d e"), 3)] * 3
    assert got[9] == got[8] == got[7] == [(0, 7)]
    assert got[None] == [(brute_print("x y"), None)] * 2
    assert got[11] == got[12] == [(brute_print(long), 11)]
    assert got[20][0][0] == brute_print("ß É ss")
    kept = simhash.one_of_each_group(docs(rows))
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 3, 7, 11, 20, 21]
    assert kept.columns == docs(rows).columns


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).collect() == []
    assert simhash.one_of_each_group(docs([])).collect() == []


def test_hot_groups_and_chains_against_brute_force(spark):
    rnd = random.Random(5)
    prints = {}
    base = rnd.getrandbits(64)
    for i in range(120):  # many near copies of one fingerprint
        prints[i] = base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64))
    x = rnd.getrandbits(64)
    for i in range(200, 240):  # a chain
        x ^= (1 << (i % 64)) | (1 << ((7 * i) % 64))
        prints[i] = x
    for i in range(300, 400):
        prints[i] = rnd.getrandbits(64)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in set(prints.values())], "fp long")
    parent = {v: v for v in set(prints.values())}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for e in simhash.links(df).collect():
        a, b = e.fp % (1 << 64), e["to"] % (1 << 64)
        assert bin(a ^ b).count("1") <= 2
        parent[find(a)] = find(b)
    want = brute_components(prints)
    for i in prints:
        for j in prints:
            assert (want[i] == want[j]) == (find(prints[i]) == find(prints[j]))


def test_query_against_brute_force(spark):
    from gleanery.llm.queries import op10_simhash

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    prints = {r.doc_id: brute_print(r.text) for r in rows}
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op10_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
