import random
from collections import Counter

import numpy as np

from gleanery.llm import outliers


def brute(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    often = set()
    for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if grams[g] > 1:
            often |= {i, i + 1, i + 2}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(len(w.decode()) for w in words), symbols, len(lines) - len(set(lines)), len(often), len(lines)


def test_statistics():
    rnd = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b", "a a a a", "é|# x\né|# x\n\n\n", "a b c a b c d", "x y z", "a " * 50_000]
    texts += [" ".join(rnd.choice("ab") for _ in range(n)) for n in range(30)]
    for t in texts:
        assert outliers.text_statistics((t or "").encode()) == brute(t), t


def test_cube_root_quantiles():
    assert abs(outliers.chi_square(0.5, 5) - 4.351) < 0.02 and abs(outliers.chi_square(0.99, 5) - 15.086) < 0.1


def text(rnd, n, junk=False):
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(n)]
    return "\n".join(" ".join(w + ("%%%" if junk else "") for w in words[i : i + 12]) for i in range(0, n, 12))


def test_junk_goes_and_clean_documents_stay(docs):
    rnd = random.Random(4)
    rows = [(i, text(rnd, rnd.randrange(60, 400)), "en" if i % 5 else None, ["a", "b", None][min(i % 4, 2)]) for i in range(600)]
    rows += [(1000 + i, text(rnd, 150, True), "en", "a") for i in range(20)]
    rows += [(2000, None), (2001, ""), (2002, text(rnd, 30)), (2003, "a b c " * 100), (None, text(rnd, 100)), (5, rows[5][1]), (3000, text(rnd, 20_000))]
    got = outliers.judge(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and 1000 <= r.doc_id < 2000:
            assert not r.kept and not r.base_failed
        if r.doc_id in (2000, 2001, 2002, 2003):
            assert r.base_failed and not r.kept
        if r.doc_id is None:
            assert r.kept
    clean = [r.kept for r in got if r.doc_id is not None and r.doc_id < 1000]
    assert np.mean(clean) > 0.99
    assert outliers.judge(docs([])).collect() == []


def test_model_of_a_contaminated_group(spark):
    rng = np.random.default_rng(0)
    good, bad = rng.normal(size=(2000, outliers.DIM)), rng.normal(8, 0.1, size=(300, outliers.DIM))
    rows = [(1, *map(float, x)) for x in np.concatenate([good, bad])]
    df = spark.createDataFrame(rows, "g long, " + ", ".join(f"x{i} double" for i in range(outliers.DIM)))
    model = outliers.minimum_covariance(df).collect()
    assert len(model) == 1 and np.abs(model[0].mu).max() < 0.15


def test_small_groups_are_judged_by_their_whole_language(docs):
    rnd = random.Random(7)
    rows = [(i, text(rnd, rnd.randrange(60, 400)), "en", "large") for i in range(300)]
    rows += [(1000 + i, text(rnd, 150, True), "en", "small") for i in range(3)] + [(1100, text(rnd, 150), "en", "small")]
    rows += [(2000, text(rnd, 150, True), "rare", "one"), (2001, text(rnd, 150), "rare", "two")]
    kept = {r.doc_id: r.kept for r in outliers.judge(docs(rows)).collect()}
    assert [i for i in sorted(kept) if i >= 1000 and kept[i]] == [1100, 2001]
    assert np.mean([kept[i] for i in range(300)]) > 0.99


def brute_model(x, core=outliers.CORE):
    """Minimum covariance determinant of one group by plain loops over whole arrays."""
    floors = np.array(list(outliers.FLOORS.values()))
    middle = lambda v: np.sort(np.round(v, 3), axis=0)[(len(v) - 1) // 2]
    mid = middle(x)
    scale = np.sqrt((1.4826 * middle(np.abs(x - mid))) ** 2 + floors**2)
    z = (x - mid) / scale
    unit = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    starts = []
    for part in (None, None, unit, np.tanh(z)):
        s = np.eye(len(mid))
        if part is not None:
            s = part.T @ part / len(z)
            s = s * len(mid) / np.trace(s) + 0.05 * np.eye(len(mid))
        starts.append(s * np.outer(scale, scale))
    best = None
    for k, start in enumerate(starts):
        mu, cov, before, share = mid, start, np.inf, 0.5 if k == 1 else core
        while True:
            d = np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu)
            wanted, border = share * len(x), np.sort(d)[int(np.ceil(share * len(x))) - 1]
            low, on = d < border * (1 - 1e-9), np.abs(d - border) <= border * 1e-9
            w = np.where(low, 1.0, np.where(on, (wanted - low.sum()) / on.sum(), 0.0))
            mu = w @ x / w.sum()
            cov = (x - mu).T @ ((x - mu) * w[:, None]) / w.sum() + np.diag(floors**2)
            det, share = np.linalg.det(cov), core
            if not det < before * (1 - outliers.LESS):
                break
            before = det
        if best is None or det < best[0]:
            best = det, mu, np.linalg.inv(cov)
    d = np.einsum("ij,jk,ik->i", x - best[1], best[2], x - best[1])
    spread = max(1.0, np.sort(d)[(len(d) + 1) // 2 - 1] / outliers.chi_square(0.5, outliers.DIM))
    return best[0], d / (spread * outliers.chi_square(1 - outliers.RARE, outliers.DIM))


def vectors(rows):
    out = []
    for n, chars, symbols, dups, again, lines in (brute(t) for t in rows):
        out.append([np.log1p(n), np.log(max(chars, 1) / n), np.log1p(100 * symbols / n), np.log1p(100 * dups / max(lines, 1)), np.log1p(100 * again / n)])
    return np.array(out)


def test_verdicts_against_brute_force(docs):
    rnd = random.Random(11)
    rows = [(i, text(rnd, rnd.randrange(60, 300)), "en", "a") for i in range(160)] + [(i, text(rnd, rnd.randrange(60, 90)), "de", "b") for i in range(200, 330)]
    rows += [(400 + i, text(rnd, 120, True), "en", "a") for i in range(25)] + [(500 + i, rows[3][1], "en", "a") for i in range(60)]
    rows += [(600 + i, "\n".join([text(rnd, 12)] * 2 + [text(rnd, 60)]), "de", "b") for i in range(8)]
    got = {r.doc_id: r for r in outliers.judge(docs(rows)).collect()}
    for lang in ("en", "de"):
        own = [r for r in rows if r[2] == lang and not got[r[0]].base_failed]
        _, far = brute_model(vectors([r[1] for r in own]))
        for r, d in zip(own, far, strict=True):
            assert abs(got[r[0]].distance - d) <= 0.02 * d + 1e-3
            assert got[r[0]].kept == (got[r[0]].distance <= 1) and (got[r[0]].kept == (d <= 1) or abs(d - 1) < 0.02)
    assert not any(got[400 + i].kept for i in range(25))


def test_no_determinant_is_left_that_another_start_beats(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, outliers.DIM)) * [1, 2, 3, 1, 1], rng.normal(4, 0.5, size=(90, outliers.DIM))])
    df = spark.createDataFrame([(1, *map(float, v)) for v in x], "g long, " + ", ".join(f"x{i} double" for i in range(outliers.DIM)))
    det, _ = brute_model(x)
    assert abs(outliers.minimum_covariance(df).first().det - det) <= 0.01 * det
