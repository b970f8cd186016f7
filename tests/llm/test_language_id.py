import random
from collections import defaultdict

import numpy as np
import pytest

from gleanery.llm import language_id as L
from gleanery.llm import queries as catalogue

SMALL = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba", "é", "Q", "1", "▁b"]


def segmentations(pieces, word):
    """All ways to write START + word as pieces, as lists of ids; a letter without a piece is its bytes."""
    place = {p: i for i, p in enumerate(pieces.pieces)}
    text = L.START + word

    def rest(at):
        if at == len(text):
            yield []
        for end in range(at + 1, len(text) + 1):
            part = text[at:end]
            ids = [place[part]] if part in place else [pieces.bytes_at + b for b in part.encode()] if end == at + 1 else None
            if ids is not None:
                for more in rest(end):
                    yield ids + more

    return list(rest(0))


@pytest.fixture
def small():
    pieces = L.Pieces(SMALL)
    logs = np.log(np.random.default_rng(1).dirichlet(np.ones(pieces.size), 3).T)
    return pieces, logs


WORDS = ["a", "ab", "aba", "abab", "babab", "é", "éa", "ñ", "ñña", "日本", "b" * 9, "abaé日a", "a", "x"]


def test_forward_sums_all_segmentations(small, monkeypatch):
    pieces, logs = small
    assert "Q" not in pieces.pieces and "1" not in pieces.pieces
    want = [[np.log(sum(np.exp(logs[s, k].sum()) for s in segmentations(pieces, w))) for k in range(3)] for w in WORDS]
    for cells in (1, 20, 200_000):
        monkeypatch.setattr(L, "CELLS", cells)
        np.testing.assert_allclose(L.word_logs(pieces, WORDS, logs), want, rtol=1e-12)


def test_expected_counts(small):
    pieces, logs = small
    langs, times = np.arange(len(WORDS)) % 3, np.arange(len(WORDS)) * 2.0 + 1
    want = np.zeros(logs.shape)
    for w, k, n in zip(WORDS, langs, times, strict=True):
        ways = segmentations(pieces, w)
        p = np.array([np.exp(logs[s, k].sum()) for s in ways])
        for s, share in zip(ways, p / p.sum(), strict=True):
            for i in s:
                want[i, k] += n * share
    np.testing.assert_allclose(L.expected(pieces, WORDS, langs, times, logs) / L.UNIT, want, atol=len(WORDS) / L.UNIT)


def test_long_runs(small):
    pieces, logs = small
    word = "ab" * 3000
    found = L.word_logs(pieces, [word, "ab"], logs)
    assert np.isfinite(found).all() and (found[0] < found[1]).all()
    one = np.full(len(word) + 2, -np.inf)  # a plain forward pass
    one[0], text, place = 0.0, L.START + word, {p: i for i, p in enumerate(pieces.pieces)}
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - pieces.longest), end):
            if text[start:end] in place:
                one[end] = np.logaddexp(one[end], one[start] + logs[place[text[start:end]], 1])
    np.testing.assert_allclose(found[0, 1], one[len(text)], rtol=1e-12)


TEXTS = {"xx": "the cat and the dog are here", "yy": "le chat et la souris sont ici", "zz": "кот и собака тут"}


def test_small_tables(spark, docs, monkeypatch):
    rows = [(i, TEXTS[k], k) for i, k in enumerate(list(TEXTS) * 12)]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 34 !?", "yy"), (1003, "chat", None), (None, "кот", None), (7, "the dog", "xx"), (7, "the dog", "xx"), (1004, "the " * 50_000, "xx"), (1005, "a" * 3000, None)]
    df = docs([(i, t, k) for i, t, k in rows])
    model = L.fit(df)
    assert model.languages == ["en", "xx", "yy", "zz"] or model.languages == ["xx", "yy", "zz"]
    found = defaultdict(list)
    for r in L.identify(df, model).collect():
        found[r.doc_id].append((r.lang_pred, r.score))
    assert len(rows) == sum(map(len, found.values()))
    assert all(found[i][0][0] == k for i, (_, _, k) in enumerate(rows[:6]))
    assert [found[i][0] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert found[1003][0][0] == "yy" and found[None][0][0] == "zz" and found[1004][0][0] == "xx"
    assert len(set(found[7][-2:])) == 1 and all(0 <= s <= 1 for v in found.values() for _, s in v)
    want = sorted(map(str, L.identify(df, model).collect()))
    monkeypatch.setattr(L, "LANGUAGES", 1)  # a pass for each language
    blocks = L.fit(df.repartition(5))
    assert len(blocks.blocks) == len(model.languages)
    assert np.array_equal(np.concatenate(blocks.blocks, axis=1), np.concatenate(model.blocks, axis=1))  # partitions and blocks don't matter
    again = sorted(map(str, L.identify(df, blocks).collect()))
    assert [x.split("score")[0] for x in again] == [x.split("score")[0] for x in want]
    none = L.fit(df.where("doc_id > 5000"))
    assert {(r.lang_pred, r.score) for r in L.identify(df, none).collect()} == {("und", 0.0)}
    assert L.identify(df.where("doc_id > 5000"), model).collect() == []


def test_inputs_are_the_text_alone(spark, docs):
    rows = [(i, TEXTS[k], k) for i, k in enumerate(list(TEXTS) * 12)]
    random.seed(1)
    model = L.fit(docs(rows))
    one = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs(rows), model).collect()}
    other = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs([(i, t, random.choice(["a", "b"])) for i, t, _ in rows]), model).collect()}
    assert one == other


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = catalogue.queries()["op12_language_id"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(held) > 250 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
