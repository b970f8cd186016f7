import random
from hashlib import sha256

import numpy as np

from gleanery.llm import scaled_sketch as S


def grams(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_estimates_follow_exact_values():
    rnd, maker = random.Random(1), S.Sketcher()
    words = [f"w{i}" for i in range(5000)]
    for n in (2000, 5000):
        a = [rnd.choice(words) for _ in range(n)]
        b = a[: n // 2] + [rnd.choice(words) for _ in range(2 * n)]
        x, y = " ".join(a), " ".join(b)
        sa, sb = maker.sketch(x.encode()), maker.sketch(y.encode())
        exact = len(grams(x) & grams(y))
        assert abs(S.likeness(sa, sb) - exact / len(grams(x) | grams(y))) < 0.05
        assert abs(S.containment(sa, sb) - exact / len(grams(x))) < 0.1
        assert abs(len(sa.hashes) / len(grams(x)) - 1 / S.SCALE) < 0.03
        merged = np.union1d(sa.hashes, sb.hashes)
        assert set(maker.sketch((x + " | " + y).encode()).hashes) >= set(merged), "sketches merge"


def test_edited_texts_and_order(docs, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 7)  # several ranges
    rnd = random.Random(3)
    rows = [(i * 3, " ".join(rnd.choice("aé b cc ddd".split()) for _ in range(rnd.randrange(40)))) for i in range(60)]
    rows += [(9, "twice"), (1000, None), (1001, ""), (1002, "long " * 30_000), (None, "last"), (None, "last")]
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    want = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 4
        want.append((doc_id, len(text), sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()))
    got = S.fingerprints(docs(rows)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
    prints = {r.doc_id: r for r in got}
    assert prints[1000].fingerprint == prints[1001].fingerprint == "" and prints[1000].near_next == 1.0
    assert len({r.fingerprint for r in got if r.doc_id is None}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert S.fingerprints(docs([])).collect() == []
    alone = S.fingerprints(docs([(1, "a b c d")])).collect()
    assert len(alone) == 1 and alone[0].edited_sha256 == sha256(b"a b c a").hexdigest()


def test_likeness_of_whole_result_against_brute_force(docs):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("ab cd ef gh ij kl".split()) for _ in range(rnd.choice([0, 3, 5, 7, 12, 60, 110])))) for i in range(80)]
    rows += [(100, "one two three four five six"), (101, "one two three four five seven"), (102, "x y z"), (103, "x y w")]
    got = {r.doc_id: r for r in S.fingerprints(docs(rows)).collect()}
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        like = lambda x, y: len(x & y) / len(x | y) if x or y else 1.0
        mine, edited, other = grams(text), grams(text[: len(text) - cut] + following[:cut]), grams(following)
        r = got[doc_id]
        assert abs(r.near_edited - like(mine, edited)) < 1e-9 and abs(r.near_next - like(mine, other)) < 1e-9
        assert (r.fingerprint == r.edited_fingerprint) == (mine == edited)
    by = {}
    for doc_id, text in rows:
        by.setdefault(got[doc_id].fingerprint, set()).add(frozenset(grams(text)))
    assert all(len(x) == 1 for x in by.values()), "unequal shingle sets have unequal fingerprints"


def test_short_text_in_a_long_one():
    maker = S.Sketcher()
    words = [f"w{i}" for i in range(3000)]
    short, long = maker.sketch(" ".join(words[500:600]).encode()), maker.sketch(" ".join(words).encode())
    assert short.whole and not long.whole
    assert S.containment(short, long) == 1.0 and S.containment(maker.sketch(b"nothing like this at all"), long) in (0.0, None)
    assert abs(S.likeness(short, long) - 96 / 2996) < 0.03
