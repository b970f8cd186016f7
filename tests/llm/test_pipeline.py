import random
from collections import Counter

from test_line_dedup import brute as lines_left
from test_packing import check as check_packing
from test_simhash import brute_components

import corpus_pipeline
from gleanery.llm import quality_knn
from gleanery.llm.common import Recent
from gleanery.llm.simhash import shingle_print
from gleanery.llm.substring_dedup import shingle_hashes, word_hashes


def corpus(rnd):
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    rows = [(i, "\n".join(prose(rnd.randrange(5, 25)) for _ in range(rnd.randrange(1, 6))), "en", f"s{i % 4}") for i in range(150)]
    shared = prose(9) + "\n" + prose(8)
    rows += [(200 + i, f"{prose(30)}\n{shared}\n{prose(30)}", "en", "s0") for i in range(5)]
    one = prose(60)
    rows += [(300 + i, one, "en", "s1") for i in range(4)] + [(310, one + " " + prose(1), "en", "s2")]
    rows += [(400 + i, " ".join(w.upper() + "!!" for w in prose(40).split()), "en", "s3") for i in range(60)]
    return rows + [(500, None, None, None), (501, "", "en", None), (0, rows[0][1], "en", "s0")]


def firsts(rows):
    """The least doc_id of each group, by brute force: five-word shingles, similarity 0.8 or fingerprints of two bits' difference."""
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    cache = Recent(1000)
    prints = [shingle_print(shingle_hashes(word_hashes([x.encode() for x in w], cache))) if w else 0 for w in words]
    groups = brute_components(dict(enumerate(prints)))
    holders = {}
    for i, own in enumerate(sets):
        for g in own:
            holders.setdefault(g, []).append(i)
    shared = Counter((a, b) for ids in holders.values() for b in ids for a in ids if a < b)
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)] + list(groups.items())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (doc_id is None, doc_id or 0))
    return sorted(d for _, d in least.values())


def key(r):
    return tuple(map(str, r))


def test_stages_against_brute_force(spark, docs, tmp_path):
    rows = corpus(random.Random(8))
    labels = [(i, int(i < 400), 0) for i, *_ in rows if i < 480 and i % 2 == 0]
    sf = str(tmp_path / "tables")
    docs(rows, extra=False).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet")
    columns, at = table.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = table
        out = stage(spark, before, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        at[name] = (before, table)
        assert name == "packing" or table.columns == columns

    before, after = at["quality classifier"]
    scores = {r.doc_id: r.score for r in quality_knn.judge(before, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert sorted(map(key, after.collect())) == sorted(key(r) for r in before.collect() if scores[r.doc_id] >= 0.3)
    assert sum(400 <= r.doc_id < 460 for r in after.collect()) == 0 and after.count() >= len(rows) - 62

    before, after = at["line dedup"]
    given = sorted(before.collect(), key=lambda r: r.doc_id)
    assert sorted(key((r.doc_id, r.text)) for r in after.collect()) == sorted(key((r.doc_id, t)) for r, t in zip(given, [x[0] for x in lines_left([(r.doc_id, r.text) for r in given], 2, 20)], strict=True))

    before, after = at["SimHash near-dedup"]
    assert sorted(r.doc_id for r in after.collect()) == firsts([(r.doc_id, r.text) for r in before.collect()])

    before, after = at["mixing"]
    had, took, most = Counter(), Counter(), 0
    for r in before.collect():
        had[r.source] += len((r.text or "").split())
        most = max(most, len((r.text or "").split()))
    times = Counter(map(key, after.collect()))
    assert set(times) <= set(map(key, before.collect())) and max(times.values()) <= 2
    for r in after.collect():
        took[r.source] += len((r.text or "").split())
    assert abs(sum(took.values()) - 1.5 * sum(had.values())) <= 6 * most and all(took[s] <= 2 * had[s] for s in had)

    before, after = at["packing"]
    check_packing([(r.doc_id, r.text) for r in before.collect()], after.collect())

    whole = corpus_pipeline.run(spark, sf)
    pick = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert pick(whole) == pick(after)


def test_empty_tables(spark, docs, tmp_path):
    sf = str(tmp_path / "none")
    docs([], extra=False).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).collect() == []


def test_near_copies_go_down_to_similarity_four_fifths(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, table, "")
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == firsts([(r.doc_id, r.text) for r in table.collect()])
