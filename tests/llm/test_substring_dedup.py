import random

import numpy as np

from gleanery.llm import substring_dedup as S


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghé") for _ in range(rnd.randrange(2, 8))) for _ in range(n))


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_paragraphs_against_brute_force(spark, docs):
    rnd = random.Random(3)
    base = [prose(rnd, 60) for _ in range(6)]
    rows = []
    for i in range(90):  # groups of near copies, and others
        words = base[i % 6].split()
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = "edit"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, prose(rnd, 50)) for i in range(30)]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and jaccard(a, b) >= 0.8:
                parent[find(i)] = find(j)
    got = {}
    for r in S.repeats(docs(rows)).collect():
        if r.start == 0 and r.end == len(dict(rows)[r.doc_id]):
            got[r.doc_id] = r.class_id
    same = [(i, j) for i in range(90) for j in range(i) if find(i) == find(j)]
    assert same and np.mean([got.get(i) is not None and got.get(i) == got.get(j) for i, j in same]) > 0.99
    assert not [i for i in got if i >= 100]
    assert all(find(i) == find(j) for i in got for j in got if got[i] == got[j])


def test_hot_buckets_stay_whole(docs):
    rnd = random.Random(9)
    base, rows = prose(rnd, 80).split(), []
    for i in range(300):
        words = list(base)
        words[i % 80] = f"v{i}"
        rows.append((i, " ".join(words)))
    got = [r for r in S.repeats(docs(rows)).collect() if r.start == 0 and r.end == len(rows[r.doc_id][1])]
    assert len(got) == 300 and len({r.class_id for r in got}) == 1 and sum(not r.removed for r in got) == 1


def test_passages_inside_other_text(docs):
    rnd = random.Random(5)
    passage = prose(rnd, 55)
    rows = [(i, f"{prose(rnd, rnd.randrange(80))} {passage} {prose(rnd, rnd.randrange(80))}") for i in range(12)]
    rows += [(50 + i, prose(rnd, 300)) for i in range(12)]
    got = S.repeats(docs(rows)).collect()
    assert {r.doc_id for r in got} == set(range(12))
    for r in got:
        assert dict(rows)[r.doc_id][r.start : r.end] in passage
        first = min(x.doc_id for x in got if x.class_id == r.class_id)
        assert r.first_doc_id == first and r.removed == (r.doc_id != first)
    whole = [k for k in {r.class_id for r in got} if sum(r.class_id == k for r in got) == 12]
    assert whole, "a block in all of them"


def test_edges_and_cut_texts(docs):
    rnd = random.Random(6)
    line = prose(rnd, 30)
    huge = "x" * 100_000
    rows = [(2, f"one\n{line}\ntwo"), (1, f"{line}\nthree"), (None, line), (3, None), (4, ""), (5, line), (5, line), (6, huge), (7, "a " * 3000), (8, "Les.\nLes.\nLes.")]
    table = docs(rows)
    out = S.without_repeats(table)
    assert out.columns == table.columns
    texts = sorted((str(r.doc_id), r.text) for r in out.collect() if r.text is not None)
    assert ("1", f"{line}\nthree") in texts and ("2", "one\n\ntwo") in texts and texts.count(("5", "")) == 2 and ("None", "") in texts
    assert ("6", huge) in texts and ("8", "Les.\nLes.\nLes.") in texts
    assert S.repeats(docs([])).collect() == []


def test_cuts_depend_on_nearby_words_only():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, size=200, dtype=np.uint64)
    own = set(S.cuts(h)[1:-1])
    moved = {c - 30 for c in S.cuts(np.concatenate([rng.integers(0, 1 << 63, size=30, dtype=np.uint64), h]))}
    assert {c for c in own if c > S.NEAR} <= moved


def test_pairs_within_a_template_family(docs):
    rnd = random.Random(12)
    template, rows = prose(rnd, 120).split(), []
    for i in range(400):  # pairs of similarity 0.9 in a family of 0.6 to 0.7: no pivot resembles a pair
        words = template[:100] + prose(rnd, 20).split()
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-4], *prose(rnd, 4).split()]))]
    assert jaccard(rows[0][1], rows[1][1]) >= 0.8 > jaccard(rows[0][1], rows[2][1])
    got = {r.doc_id: r.class_id for r in S.repeats(docs(rows)).collect() if r.start == 0 and r.end == len(rows[r.doc_id][1])}
    met = [got.get(2 * i) is not None and got.get(2 * i) == got.get(2 * i + 1) for i in range(400)]
    assert np.mean(met) > 0.995 and len(set(got.values())) == sum(met)


def test_small_buckets_compare_all_pairs(spark):
    rows = [(k, [7] * S.BANDS) for k in range(S.SMALL)]
    pairs, large = S.candidate_pairs(spark.createDataFrame(rows, "key long, bands array<long>"))
    assert {(r.a, r.b) for r in pairs.collect()} == {(a, b) for b in range(S.SMALL) for a in range(b)} and large.isEmpty()


def test_separate_pairs_are_all_pairs_of_the_similarity(spark):
    rnd = random.Random(4)
    sets = {k: set(rnd.sample(range(14), rnd.randrange(4, 14))) | {100 + k % 3} for k in range(80)}
    sets |= {200 + k: set(range(20)) - {k} for k in range(20)}
    root = {k: k if k < 200 else 200 + k % 2 for k in sets}
    table = spark.createDataFrame([(k, sorted(x)) for k, x in sets.items()], "key long, shingles array<long>")
    roots = spark.createDataFrame([(k, r) for k, r in root.items() if k >= 200], "key long, root long")
    got = {(r.a, r.b) for r in S.separate_pairs(table, roots, 0.8).collect()}
    want = {(a, b) for b in sets for a in sets if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert want and want <= got and all(root[a] != root[b] for a, b in got)


def test_paragraphs_are_long_lines_and_runs_of_shorter_ones():
    import numpy as np

    from gleanery.llm.substring_dedup import paragraph_bounds

    # lines of 5, 25, 12, 12, blank, 9, 19, 3, blank, 19 words
    lines = np.cumsum([0, 5, 25, 12, 12, 0, 9, 19, 3, 0, 19])
    first, last = paragraph_bounds(lines)
    assert list(zip(first.tolist(), last.tolist(), strict=True)) == [(5, 30), (30, 54), (54, 85)]
    assert [len(x) for x in paragraph_bounds(np.array([0, 0, 0]))] == [0, 0]


def test_near_copies_of_wrapped_paragraphs(docs):
    import random

    from gleanery.llm import substring_dedup

    rnd = random.Random(3)
    words = [f"v{rnd.randrange(10**6)}" for _ in range(120)]
    other = [w if i not in (30, 90) else "changed" for i, w in enumerate(words)]
    wrap = lambda ws, n: "\n".join(" ".join(ws[i : i + n]) for i in range(0, len(ws), n))
    rows = [(1, "head\n\n" + wrap(words, 11) + "\n\ntail"), (2, "start\n\n" + wrap(other, 13) + "\n\nend of it")]
    found = [r for r in substring_dedup.repeats(docs(rows)).collect() if r.end - r.start > 500]
    assert {r.doc_id for r in found} == {1, 2} and len({r.class_id for r in found}) == 1


def test_texts_taken_together_have_the_units_of_each_alone(monkeypatch):
    import pyarrow as pa

    rnd, calls = random.Random(8), []
    texts = ["", " ", "\n", prose(rnd, 15), prose(rnd, 16), prose(rnd, 20), "é ü " * 20, "\n".join(["q w e r t"] * 9), prose(rnd, 90), "", prose(rnd, 300) + "\n" + prose(rnd, 30) + "\n\nend", "x " * 40]
    texts += ["".join(rnd.choice(["ab ", "é ", "\n", " ", "\n\n", prose(rnd, 6) + " "]) for _ in range(rnd.randrange(40))) for _ in range(60)]
    alone = [tuple(map(tuple, np.column_stack(S.Units().of([t.encode()])[1:4]).tolist())) for t in texts]
    of, start, end, key, bands = S.Units().of([t.encode() for t in texts])
    rows = np.column_stack([start, end, key]).tolist()
    for i, want in enumerate(alone):
        assert sorted(tuple(r) for r, k in zip(rows, of, strict=True) if k == i) == sorted(want)
        assert all(texts[i][a:b] == texts[i][a:b].strip() for a, b, _ in want)
    assert sum(len(S.Units().of([t.encode()])[4]) for t in texts) == len(bands) and sum(map(len, alone)) == len(rows)

    class Caught:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    monkeypatch.setattr(S, "with_uid", lambda docs: docs)
    monkeypatch.setattr(S.Units, "of", lambda self, x, own=S.Units.of: calls.append(len(x)) or own(self, x))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 1)), pa.array([*texts, None])], ["uid", "text"])
    got = [r for b in S.paragraphs(Caught())(iter([batch])) for r in b.to_pylist()]
    assert calls == [len(texts) + 1]  # not once a text
    assert sorted((r["uid"], r["start"], r["end"], r["key"]) for r in got) == sorted((i, *r) for i, x in enumerate(alone) for r in x)
