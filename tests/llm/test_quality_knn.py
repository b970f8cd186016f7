import random
import zlib

import numpy as np
import pytest

from gleanery.llm import quality_knn as Q


def sample(n=300):
    rnd, rows, labels = random.Random(1), [], []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(rnd.randrange(20, 90))]
        good = i % 3 > 0
        rows.append((i, " ".join(w if good else w.upper() + "!!" for w in words)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_edges(spark, docs):
    rows, labels = sample()
    more = [(900, None), (901, ""), (902, " \n"), (903, "good words here " * 20_000), (None, rows[1][1]), (4, rows[4][1]), (4, rows[4][1])]
    table = spark.createDataFrame(labels + [(5000, 1, 0), (7, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = Q.judge(docs(rows + more), table).collect()
    assert len(got) == len(rows) + len(more)
    by = {r.doc_id: r for r in got}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out == (i in held) for i, _ in rows)
    assert np.mean([by[i].predicted == labels[i][1] for i in held]) > 0.95
    assert by[900].score == by[901].score == by[902].score and 0.5 < by[900].score < 0.8
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = Q.accepted(docs(rows), table)
    assert kept.columns == docs(rows).columns and 180 <= kept.count() <= 220
    assert Q.judge(docs([]), table).collect() == []
    assert {r.score for r in Q.judge(docs(rows[:3]), table.limit(0)).collect()} == {1.0}


def test_held_out_labels_do_not_matter(spark, docs):
    rows, labels = sample(120)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in labels]
    a, b = ({r.doc_id: r.score for r in Q.judge(docs(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()} for x in (labels, flipped))
    assert a == b


def test_block_scores_equal_brute_force():
    rows, labels = sample(100)
    terms = Q.Terms()
    made = [terms.row(t.encode()) for _, t in rows]
    model = Q.fit(made, np.array([x[1] for x in labels]), 2 / 3)
    got = Q.score_block(model, made[:20], 7)
    for (ids, values), score in zip(made[:20], got, strict=True):
        full = np.zeros(Q.HASHED)
        for i, v in zip(ids, values, strict=True):
            full[i] += v
        x = (full * model.idf) @ model.basis
        cos = (x / np.linalg.norm(x)) @ model.vectors
        near = np.argsort(-cos)[:7]
        w = np.maximum(cos[near], 0) ** 4
        share = model.labels.mean()
        one, zero = (w * model.labels[near]).sum() * model.prior / share, (w * (1 - model.labels[near])).sum() * (1 - model.prior) / (1 - share)
        assert score == pytest.approx((one + 1e-3 * model.prior) / (one + zero + 1e-3), abs=1e-3)
