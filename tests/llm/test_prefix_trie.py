import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from gleanery.llm import prefix_trie
from gleanery.llm import queries as catalogue

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """The contract by plain loops over all prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    said = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(said.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    saved, leaves = {}, {}
    for path in sorted(members, key=len, reverse=True):
        n = len(members[path])
        saved[path] = ((n - 1) * len(path[-1][1].encode().split()) if path else 0) + sum(saved[x] for x in children[path])
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
    out = []
    for path, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if rebuilt[c] == path)))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def made(seed):
    random.seed(seed)
    rows = []
    for c in random.sample(range(-100, 400), 200):
        for turn in range(random.choice([0, 1, 2, 3, 4, 9])):
            rows.append((c, None if random.random() < 0.1 else turn, random.choice(["user", "assistant", "", None]), random.choice(["a b", "a", "", None, "c  d\te", "x" * 50])))
    opening = [(t, "user", f"hello {t}") for t in range(6)]
    rows += [(c, *x) for c in range(1000, 1100) for x in opening[: random.choice([6, 6, 6, 2])]]  # copies
    rows += [(2000, t, "user", f"long {t % 3}") for t in range(70)] + [(2001, t, "user", f"long {t % 3}") for t in range(70)]  # a long path of two
    rows += [(3000, 1, "user", "same row")] * 40 + [(3001, 1, "user", "same row")] * 39 + [(None, 1, "user", "nobody"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_loops(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = made(seed)
    random.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as pos", "1 as n_convs", "'k' as k1", "2.0 as length").repartition(5)
    assert found(prefix_trie.conversation_trie(df)) == brute(rows)


def test_partitioning_does_not_matter(spark):
    rows = made(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(int(partitions)))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_tables(spark):
    for rows in ([], [(None, 1, "user", "x")], [(5, 0, "user", "x")], [(21, 0, "user", "x"), (40, None, None, None)]):
        assert found(prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == (brute(rows) if any(r[0] is not None for r in rows) else [])


def test_query_equals_sql_and_loops(spark):
    sf = "/root/testdata/sf0.01"
    got = found(catalogue.queries()["op13_prefix_trie"](spark, sf))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'").fetchall()
    assert got == sorted(con.sql(catalogue.oracle_sql()["op13_prefix_trie"]).select(*COLUMNS).fetchall(), key=str)
    assert got == brute([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
