import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleanery.llm import packing
from gleanery.llm.subwords import Subwords, default_tokenizer

TOKENIZER = Tokenizer.from_file(default_tokenizer())


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, got, capacity=4096):
    """Exact cover of each document, right hashes, gapless sequences."""
    left = defaultdict(list)
    for doc_id, text in rows:
        left[doc_id].append(ids_of(text))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(left)
    for doc_id, copies in left.items():
        spans = sorted((r.doc_tokens, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id])
        if len(copies) == 1:
            at = 0
            for n, start, length, crc in spans:
                assert start == at and n == len(copies[0])
                assert crc == zlib.crc32(np.array(copies[0][at : at + length], dtype="<u4").tobytes())
                at += length
            assert at == len(copies[0])
        else:
            assert sum(s[2] for s in spans) == sum(map(len, copies))
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding, len(by_sequence)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aB. 's,ÉéİK \x1c\x85٣<|endoftext>ЖΣ\n\t1!"), max_size=60))
def test_cached_words_give_the_tokenizers_ids(text):
    own = Subwords(default_tokenizer())
    for _ in range(2):
        assert np.frombuffer(own.of_text(text.encode()), dtype="<u2").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), max_size=5), st.integers(0, 60))
def test_window_is_filled_as_brute_force_does(counts, room):
    lengths = sorted(counts.items(), reverse=True)
    found = packing.fill_window(lengths, room)
    assert all(0 < n <= counts[x] for x, n in found.items())
    sums = {sum(x * n for (x, _), n in zip(lengths, c, strict=True)) for c in itertools.product(*(range(n + 1) for _, n in lengths))}
    assert sum(x * n for x, n in found.items()) == max(s for s in sums if s <= room)


def test_patterns_use_up_the_histogram():
    rnd = random.Random(1)
    histogram = {rnd.randrange(1, 4097): rnd.randrange(1, 10_000) for _ in range(300)}
    used = defaultdict(int)
    patterns = packing.minimum_bin_slack(histogram, 4096)
    for p in patterns:
        assert sum(x * n for x, n in p.counts.items()) <= 4096
        for x, n in p.counts.items():
            used[x] += n * p.times
    assert used == histogram and len(patterns) <= 2 * len(histogram)


def test_edges(docs):
    rnd = random.Random(2)
    word = lambda n: " ".join(rnd.choice(["the", "Of", "x1!", "thntble", "éaux"]) for _ in range(n))
    rows = [(i, word(rnd.randrange(300))) for i in range(40)] + [(50, None), (51, ""), (52, " \n"), (53, word(30_000)), (None, "a b"), (60, "same"), (60, "same")]
    got = packing.pack(docs(rows)).collect()
    padding, _ = check(rows, got)
    assert padding <= 64
    assert packing.pack(docs([])).collect() == []


def test_query_covers_every_document(spark):
    from gleanery.llm.queries import op2_packing

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    padding, n = check(rows, op2_packing(spark, "/root/testdata/sf0.001").collect())
    assert padding < 0.001 * n * 4096


def test_words_of_letters_and_marks_are_encoded_together(monkeypatch):
    words = ["ñandú,", "Über!?", "thheingble", "ciónmente.", "ÀÉÎõü|", "straße;", "the", "Ñ", "a-", "x#$%"]
    want = [i for w in words for i in TOKENIZER.encode(w, add_special_tokens=False).ids]
    own = Subwords(default_tokenizer())

    def one_by_one(word):
        raise AssertionError(word)

    monkeypatch.setattr(Subwords, "_parts", staticmethod(one_by_one))
    for _ in range(2):
        assert np.frombuffer(own.of_text(" ".join(words).encode()), dtype="<u2").tolist() == want
