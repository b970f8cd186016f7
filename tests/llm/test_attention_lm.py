import math
import zlib
from collections import Counter

import numpy as np
import pytest

from gleanery.llm import attention_lm as A


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(A, "FIT_WINDOWS", 400)
    monkeypatch.setattr(A, "HEAD", 5)
    monkeypatch.setattr(A, "STEP", 16)


def slow_score(s, ids):
    """ln P of each token by plain loops over each token's window."""
    w, c, end = s.w, s.classes, s.end
    inputs, targets = [end, *ids], [*ids, end]
    out = []
    for t in range(len(inputs)):
        low = max(0, (t // A.SPAN - 1) * A.SPAN)
        e = w.e[inputs[low : t + 1]].astype(float)
        q = e[-1] @ w.q
        a = np.array([q @ (x @ w.k) / A.DIM**0.5 + w.far[t - low - i] for i, x in enumerate(e)])
        a = np.exp(a - a.max())
        ctx = (a / a.sum()) @ (e @ w.v)
        u = np.maximum(e[-1] @ w.x + ctx @ w.c + w.b, 0)
        one, two = u @ w.out + w.b2, u @ w.sub[c.group[targets[t]]] + w.b3[c.group[targets[t]]]
        ln = lambda z, k: z[k] - z.max() - math.log(np.exp(z - z.max()).sum())
        out.append(ln(one, c.group[targets[t]]) + ln(two, c.member[targets[t]]) + c.inside[targets[t]])
    return out


def trained(size=60):
    rng = np.random.default_rng(0)
    texts = [np.array([(7 * k + j) % 40 for j in range(rng.integers(0, 90))], dtype=np.int32) for k in range(60)]
    counts = np.bincount(np.concatenate(texts), minlength=size).astype(float)
    counts[-1] = len(texts)
    classes = A.make_classes(counts, texts)
    return A.Scorer(A.train(texts, classes), classes), texts, classes


def test_batched_windows_equal_plain_loops():
    s, texts, classes = trained()
    texts = [*texts[:12], np.zeros(0, dtype=np.int32), np.arange(55, dtype=np.int32)]
    assert np.allclose(s.score(texts), [sum(slow_score(s, t.tolist())) / A.LN10 for t in texts], atol=1e-3)
    assert np.allclose(s.score(texts), [s.score([t])[0] for t in texts], atol=1e-4)


def test_probabilities_sum_to_one():
    s, _, classes = trained()
    for before in ([], [3, 4, 5], list(range(30))):
        total = sum(math.exp(slow_score(s, [*before, i])[len(before)]) for i in range(len(classes.group)))
        assert total == pytest.approx(1, abs=1e-4)


def test_training_learns_order():
    s, _, _ = trained()
    row = np.arange(5, 35, dtype=np.int32)
    assert s.score([row])[0] > s.score([row[::-1].copy()])[0] + 10


def test_baseline_and_edges(docs):
    rows = [(i, f"The a{i % 7} of B{i % 3} the x{i}") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "the " * 9000), (None, "The nul"), (None, "The nul"), (3, rows[3][1])]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter()
    ends = 0
    for i, t in rows:
        if not held(i):
            counts.update((t or "").lower().split())
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    got = A.score(docs(rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        words = (texts[r.doc_id] or "").lower().split()
        want = sum(math.log10((c + 1) / (total + distinct + 1)) for c in [*(counts[w] for w in words), ends])
        assert r.base_score == pytest.approx(want, rel=1e-9)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words) + 1, 1 + sum(counts[w] > 0 for w in words), total)
        assert r.score < 0
    assert A.score(docs([])).collect() == []


def test_every_token_of_a_training_text_is_a_target_once(spark):
    from gleanery.llm import attention_lm
    from gleanery.llm.subwords import default_tokenizer, loaded

    texts = ["one", " ".join(f"word{i % 50} and" for i in range(700)), None, "", " \n ", "Three SHORT words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").coalesce(1)
    name = default_tokenizer()
    found = attention_lm.training_windows(rows, name, 60_000).collect()
    windows = np.concatenate([np.frombuffer(r.rows, dtype=np.uint16).reshape(-1, 2 * attention_lm.SPAN + 1) for r in found])
    got = windows[:, attention_lm.SPAN + 1 :]
    want = [np.append(np.frombuffer(loaded(name).of_text(t.lower().encode()), dtype="<u2"), 60_000) for t in texts if t and t.split()]
    assert got[got != attention_lm.GAP].tolist() == np.concatenate(want).tolist()


def test_a_partition_is_trained_and_counted_by_blocks(spark, monkeypatch):
    """Every window is trained on once, and no task holds more of them at a time than a block, however large its partition is."""
    from gleanery.llm import attention_lm
    from gleanery.llm.subwords import default_tokenizer

    texts = [" ".join(f"word{(i * k) % 50} and" for i in range(3000)) for k in range(1, 4)]
    rows = spark.createDataFrame(list(enumerate(texts)), "uid long, text string").coalesce(1)
    size = 49_409
    table = attention_lm.training_windows(rows, default_tokenizer(), size - 1).coalesce(1).cache()
    every = np.concatenate([np.frombuffer(r.rows, dtype=np.uint16).reshape(-1, 2 * attention_lm.SPAN + 1) for r in table.collect()])
    counts = np.bincount(every[:, attention_lm.SPAN + 1 :][every[:, attention_lm.SPAN + 1 :] != attention_lm.GAP], minlength=size).astype(float)
    marks = attention_lm.make_marks(counts)
    want = attention_lm.contexts(every, marks)
    monkeypatch.setattr(attention_lm, "COUNTED", 2)
    monkeypatch.setattr(attention_lm, "TRAINED", 2)
    blocks = list(attention_lm._blocks(iter(table.toArrow().to_batches()), 1, 2))
    assert max(map(len, blocks)) <= 2 * attention_lm.CHUNK < len(every) and (np.concatenate(blocks) == every).all()
    found = attention_lm.corpus_contexts(table, marks)
    assert (found[0] == want[0]).all() and (found[1] == want[1]).all()
    classes = attention_lm.classes_of(counts, *want, len(marks))
    first = attention_lm.first_weights(classes, counts)
    before, after = (attention_lm.Scorer(w, classes).score([every[5, attention_lm.SPAN + 1 :].astype(np.int64)])[0] for w in (first, attention_lm.averaged(table, first, classes, 0)))
    assert after > before


def test_a_block_of_windows_is_trained_in_little_memory():
    import tracemalloc

    from gleanery.llm import attention_lm

    rng = np.random.default_rng(4)
    rows = rng.integers(0, 3000, size=(1 << 16, 2 * attention_lm.SPAN + 1)).astype(np.uint16)
    rows[::7, :5] = attention_lm.GAP
    counts = np.ones(3001)
    marks = attention_lm.make_marks(counts)
    classes = attention_lm.classes_of(counts, *attention_lm.contexts(rows[:500], marks), len(marks))
    weights = attention_lm.first_weights(classes, counts)
    tracemalloc.start()
    _, ids, times = attention_lm.descend(weights, classes, rows, 0, 0.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    known = rows[:, :-1][rows[:, :-1] != attention_lm.GAP]
    assert ids.tolist() == np.unique(known).tolist() and times.tolist() == np.bincount(known)[ids].tolist()
    assert peak < 3 * rows.nbytes + weights.e.nbytes * 5 + (8 << 20)  # 61 MB when ids were counted as 64-bit numbers, all at once
