import numpy as np

from gleanery.llm import attention_lm as A
from gleanery.llm.subwords import default_tokenizer, loaded


def test_texts_are_split_once_and_train_from_their_ids(spark):
    """One table has all that training and scoring need of the texts; its blocks of windows are those of the texts, each once, in bounded blocks."""
    texts = ["one", " ".join(f"word{i % 50} and" for i in range(3000)), None, "", " \n ", "Three SHORT words", " ".join(f"w{i} of" for i in range(400))]
    rows = spark.createDataFrame([(k, k, t, False) for k, t in enumerate(texts)], "uid long, doc_id long, text string, held_out boolean").coalesce(1)
    counts = A.corpus_counts(A.word_counts(rows.select("text")), len(texts))
    table = A.tokenized(rows, default_tokenizer(), counts).cache()
    size = loaded(default_tokenizer()).tokenizer.get_vocab_size() + 1
    want = [np.frombuffer(loaded(default_tokenizer()).of_text((t or "").lower().encode()), dtype=np.uint16) for t in texts]
    place = {w: k for k, w in enumerate(counts.frequent.to_pylist())}
    for r, t, ids in zip(sorted(table.collect(), key=lambda r: r.uid), texts, want, strict=True):
        words = (t or "").lower().split()
        assert np.frombuffer(r.ids, dtype=np.uint16).tolist() == ids.tolist()
        cuts = A._unpacked(np.frombuffer(r.sizes, dtype=np.uint8))
        assert len(cuts) == len(words) + 1 and cuts[-1] == len(ids)
        assert np.frombuffer(r.at, dtype=np.int32).tolist() == [place.get(w, -1) for w in words] and r.tail == [w for w in words if w not in place]
    assert (A.id_counts(table, size) == np.bincount(np.concatenate(want), minlength=size)).all()
    every = np.concatenate([np.frombuffer(r.rows, dtype=np.uint16).reshape(-1, 2 * A.SPAN + 1) for r in A.training_windows(rows.select("uid", "text"), default_tokenizer(), size - 1).collect()])
    stored = np.concatenate([np.frombuffer(r.rows, dtype=np.uint16).reshape(-1, 2 * A.SPAN + 1) for r in A.training_windows(table.select("uid", "ids"), default_tokenizer(), size - 1).collect()])
    blocks = list(A._ids_blocks(iter(table.select("ids").toArrow().to_batches()), size - 1, 1))
    assert (stored == every).all() and (np.concatenate(blocks) == every).all() and max(map(len, blocks)) <= A.CHUNK < len(every)
    marks = A.make_marks(np.bincount(np.concatenate(want), minlength=size))
    assert all((x == y).all() for x, y in zip(A.corpus_contexts(table, marks), A.contexts(every, marks), strict=True))


def test_sizes_of_any_length_are_kept():
    sizes = np.array([0, 1, 254, 255, 256, 510, 70_000, 3])
    packed, bounds = A._packed(sizes)
    assert np.diff(A._unpacked(packed)).tolist() == sizes.tolist() and (A._packed(sizes[:0])[0].tolist(), A._unpacked(packed[:0]).tolist()) == ([], [0])
    assert [packed[a:b].sum(dtype=int) for a, b in zip(bounds, bounds[1:], strict=False)] == sizes.tolist()


def test_a_step_goes_down_every_slope():
    """Adam's first step moves each weight by the same amount against its slope: held against differences of the score."""
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40, size=n) for n in (3, 20, 50, 70)]
    counts = np.bincount(np.concatenate(texts), minlength=60).astype(float)
    counts[-1] = len(texts)
    classes = A.make_classes(counts, texts)
    first = A.first_weights(classes, counts)
    rows = A.sequences(texts, 59)
    after, ids, _ = A.descend(first, classes, rows, 1, 0.01)
    assert len(rows) <= A.STEP

    def score(weights):
        return A.Scorer(weights, classes).score(texts).sum()

    held = 0
    for name, before, now in zip(A.Weights._fields, first, after, strict=True):
        moved = np.argwhere(np.abs(now - before) > 1e-3)
        for spot in moved[rng.permutation(len(moved))[:12]]:
            up, down = before.copy(), before.copy()
            up[tuple(spot)] += 0.02
            down[tuple(spot)] -= 0.02
            slope = score(first._replace(**{name: up})) - score(first._replace(**{name: down}))
            if abs(slope) > 1e-3:  # beyond what 32 bits blur
                held += 1
                assert np.sign(now[tuple(spot)] - before[tuple(spot)]) == np.sign(slope), (name, spot)
    assert held > 60


def test_workers_free_the_vocabulary_before_they_train():
    from gleanery.llm import subwords

    first = loaded(default_tokenizer())
    assert loaded(default_tokenizer()) is first
    subwords.forget()
    assert not subwords._loaded and loaded(default_tokenizer()) is not first
