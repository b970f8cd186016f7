"""Language-model scoring: causal self-attention over subword ids, trained in numpy, mixed with the corpus's word counts."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import crc_mod, delete, kept, lean, stash, stored_rows, with_uid
from gleanery.llm.subwords import default_tokenizer, forget, loaded
from gleanery.llm.words import encoded, ranges, split, words_of

#: Tokens scored per window (a window also sees as many before them), widths, groups of ids, and classes in a group, the first of which hold one frequent id each.
SPAN, DIM, HIDDEN, GROUPS, MEMBERS, SINGLE = 16, 16, 32, 32, 32, 24
#: The weights start from so many windows, in so many passes, with so many in a step. Then ROUNDS follow, each over all windows of all partitions.
FIT_WINDOWS, PASSES, STEP, ROUNDS = 60_000, 4, 128, 1
#: Ids whose neighbourhood groups the others, besides the end; windows in a row of their table; results that are added up in one task, and by the driver.
MARKS, CHUNK, FAN = 255, 256, 16
#: Of a word's probability so much comes from its count in the corpus.
BLEND = 0.3
#: So many of the most frequent words at most have their counts in all workers; counts of other words are joined.
HEAD = 1 << 18
#: Rows of the windows' table whose contexts are counted at once, and by which a partition trains in turn.
COUNTED, TRAINED = 64, 256
#: Bytes of ids that are scored together, at some fifty bytes of memory each.
SCORED = 1 << 18
#: Windows attended at once, and classed at once.
AT_ONCE, CLASSED = 256, 1024
LN10 = float(np.log(10.0))
GAP = (1 << 16) - 1
#: What a worker has made of a broadcast.
_ready: dict[str, tuple] = {}


class Classes(NamedTuple):
    """P(id) = P(group) P(class | group) P(id | class): the model gives the first two, counts over the whole training corpus the last."""

    group: np.ndarray  # id -> group
    member: np.ndarray  # id -> class in the group
    inside: np.ndarray  # id -> ln P(id | class)


class Weights(NamedTuple):
    e: np.ndarray  # id -> DIM
    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    far: np.ndarray  # bias by distance
    x: np.ndarray
    c: np.ndarray
    b: np.ndarray
    out: np.ndarray  # HIDDEN x groups
    b2: np.ndarray
    sub: np.ndarray  # groups x HIDDEN x MEMBERS
    b3: np.ndarray


class Shared(NamedTuple):
    id: str
    made: Broadcast

    @property
    def value(self) -> tuple:
        return self.made.value


# --- windows ---------------------------------------------------------------------------------------------------------


def windows(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, first) as rows of SPAN ids. Each text's inputs are `end` and its ids, its targets its ids and `end`; -1 fills up.

    first marks the rows that begin a text. A row's context is itself and the row before, so windows overlap by half, and each
    token is a target once.
    """
    rows = [-(-(len(t) + 1) // SPAN) for t in texts]
    total = sum(rows)
    inputs, targets, first = np.full(total * SPAN, -1, dtype=np.int32), np.full(total * SPAN, -1, dtype=np.int32), np.zeros(total, dtype=bool)
    at = 0
    for t, n in zip(texts, rows, strict=True):
        a, m = at * SPAN, len(t)
        inputs[a] = end
        inputs[a + 1 : a + 1 + m] = t
        targets[a : a + m] = t
        targets[a + m] = end
        first[at] = True
        at += n
    return inputs.reshape(-1, SPAN), targets.reshape(-1, SPAN), first


_QUERY, _KEY = np.arange(SPAN)[:, None] + SPAN, np.arange(2 * SPAN)[None, :]
DISTANCE = np.clip(_QUERY - _KEY, 0, 2 * SPAN - 1)
CAUSAL = _KEY <= _QUERY


# --- scoring ---------------------------------------------------------------------------------------------------------


def _log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ln softmax of each row at one column; overwrites logits."""
    chosen = logits[np.arange(len(at)), at]
    np.exp(logits, out=logits)
    return chosen - np.log(logits @ np.ones(logits.shape[1], dtype=np.float32))


def _paired(rows: np.ndarray) -> np.ndarray:
    """Each row (but the first) after the one before it, as a view: rows overlap by half."""
    n, span, width = rows.shape
    return np.lib.stride_tricks.as_strided(rows, (n - 1, 2 * span, width), rows.strides)


class Scorer:
    def __init__(self, weights: Weights, classes: Classes):
        w = self.w = Weights(*(np.asarray(a, dtype=np.float32) for a in weights))
        self.classes, self.end = classes, len(classes.group) - 1
        # what an id always gives: query, key, value with a one that adds up the weights, and its own part of the hidden layer
        ones = np.ones((len(w.e), 1), dtype=np.float32)
        self.kv, self.qx = np.concatenate([w.e @ w.k, w.e @ w.v, ones], axis=1), np.concatenate([w.e @ (w.q / np.float32(DIM**0.5)), w.e @ w.x + w.b], axis=1)
        self.bias = np.where(CAUSAL, w.far[DISTANCE], np.float32(-1e9)).astype(np.float32)
        self.alone = np.zeros_like(self.bias)
        self.alone[:, :SPAN] = -1e9
        self.group, self.member = classes.group.astype(np.int16), classes.member.astype(np.int16)

    def _hidden(self, inputs: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
        """Hidden layer of all rows but the first of `inputs`, which is the context of the second."""
        kv, qx = _paired(self.kv.take(inputs.ravel(), axis=0).reshape(*inputs.shape, -1)), self.qx.take(inputs[1:].ravel(), axis=0)
        s = np.matmul(qx[:, :DIM].reshape(len(first), SPAN, DIM), kv[..., :DIM].transpose(0, 2, 1))
        s += self.bias
        s[first] += self.alone  # the row before is another text's
        np.exp(s, out=s)
        c = np.matmul(s, kv[..., DIM:]).reshape(-1, DIM + 1)
        np.matmul(c[:, :DIM] / c[:, DIM:], self.w.c, out=out)
        out += qx[:, DIM:]
        np.maximum(out, 0, out=out)

    def token_scores(self, inputs: np.ndarray, targets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """ln P of every target, row by row."""
        out = np.empty(len(inputs) * SPAN, dtype=np.float64)
        inputs, targets = np.maximum(np.concatenate([inputs[:1], inputs]), 0), targets.ravel()
        for low in range(0, len(first), CLASSED):
            high = min(len(first), low + CLASSED)
            u = np.empty(((high - low) * SPAN, HIDDEN), dtype=np.float32)
            for a in range(low, high, AT_ONCE):
                b = min(high, a + AT_ONCE)
                self._hidden(inputs[a : b + 1], first[a:b], u[(a - low) * SPAN : (b - low) * SPAN])
            t = np.maximum(targets[low * SPAN : high * SPAN], 0)
            group, member = self.group[t], self.member[t]
            ln = self.classes.inside[t] + _log_softmax_at(u @ self.w.out + self.w.b2, group)
            order = np.argsort(group, kind="stable")
            u, within, bounds = u[order], member[order], np.searchsorted(group[order], np.arange(len(self.w.b3) + 1))
            among = np.empty(len(t), dtype=np.float32)
            for g in np.flatnonzero(np.diff(bounds)):
                part = slice(bounds[g], bounds[g + 1])
                among[part] = _log_softmax_at(u[part] @ self.w.sub[g] + self.w.b3[g], within[part])
            ln[order] += among
            out[low * SPAN : high * SPAN] = ln
        return out[targets >= 0]

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text's ids and its end."""
        if not texts:
            return np.zeros(0)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        return np.add.reduceat(self.token_scores(*windows(texts, self.end)), starts) / LN10


# --- training --------------------------------------------------------------------------------------------------------


def _clusters(points: np.ndarray, weight: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Weighted k-means from the k heaviest points; cluster numbers without gaps."""
    k = min(k, len(points))
    centres = points[np.argsort(-weight, kind="stable")[:k]].copy()
    for _ in range(rounds):
        near = np.argmax(points @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        for j in range(k):
            if (near == j).any():
                centres[j] = np.average(points[near == j], axis=0, weights=weight[near == j])
    return np.unique(near, return_inverse=True)[1]


def contexts(rows: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, times): how often each id of the sequences (GAP: nothing) stands after or before each mark; key is (id, side, mark)."""
    place = np.full(GAP + 1, -1, dtype=np.int32)
    place[marks] = np.arange(len(marks))
    keys = []
    for side, (own, near) in enumerate(((rows[:, 1:], rows[:, :-1]), (rows[:, :-1], rows[:, 1:]))):
        by = place[near]
        ok = (own != GAP) & (by >= 0)
        keys.append((own[ok].astype(np.int32) * 2 + side) * len(marks) + by[ok])  # below 2^25
    keys, times = np.unique(np.concatenate(keys), return_counts=True)
    return keys.astype(np.int64), times


def make_marks(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(counts) - 1], np.argsort(-counts[:-1], kind="stable")[:MARKS]])


def classes_of(counts: np.ndarray, keys: np.ndarray, times: np.ndarray, marks: int) -> Classes:
    """counts: of each id and the end (last) in the corpus; keys, times: contexts(). Ids are grouped by what stands before and
    after them; a group's most frequent ids are classes of their own, its other ids are clustered again. The end is a group, and
    so are all ids without a context."""
    size = len(counts)
    group, member = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
    of = keys // (2 * marks)
    ids = np.unique(of[of < size - 1])
    group[size - 1] = 0
    if len(ids):
        where = np.full(size, -1, dtype=np.int64)
        where[ids] = np.arange(len(ids))
        context, ok = np.zeros((len(ids), 2 * marks), dtype=np.float32), where[of] >= 0
        context[where[of[ok]], keys[ok] % (2 * marks)] = times[ok]
        context = np.sqrt(context / np.maximum(context.sum(axis=1, keepdims=True), 1))
        weight = counts[ids] + 1.0
        group[ids] = 1 + _clusters(context, np.sqrt(weight), GROUPS)
        for g in range(1, group.max() + 1):
            rows = np.flatnonzero(group[ids] == g)
            rows = rows[np.argsort(-weight[rows], kind="stable")]
            member[ids[rows[:SINGLE]]] = np.arange(min(SINGLE, len(rows)))
            if len(rest := rows[SINGLE:]):
                member[ids[rest]] = SINGLE + _clusters(context[rest], np.sqrt(weight[rest]), MEMBERS - SINGLE)
    group[group < 0] = group.max() + 1
    key = group * MEMBERS + member
    smooth = counts + 0.1
    return Classes(group, member, np.log(smooth) - np.log(np.bincount(key, weights=smooth)[key]))


def sequences(texts: list[np.ndarray], end: int) -> np.ndarray:
    """All windows of texts as rows of 2 * SPAN + 1 ids, GAP where there is none: a row's inputs are its ids but the last, and its last SPAN ids are the targets."""
    inputs, targets, first = windows(texts, end)
    before = np.concatenate([inputs[:1], inputs[:-1]])
    before[first] = -1
    rows = np.concatenate([before, inputs[:, :1], targets], axis=1)
    return np.where(rows < 0, GAP, rows).astype(np.uint16)


def make_classes(counts: np.ndarray, texts: list[np.ndarray]) -> Classes:
    marks = make_marks(counts)
    return classes_of(counts, *contexts(sequences(texts, len(counts) - 1), marks), len(marks))


def first_weights(classes: Classes, counts: np.ndarray, seed: int = 1) -> Weights:
    """Random weights; the biases give the classes' shares in the corpus."""
    rng, groups = np.random.default_rng(seed), int(classes.group.max()) + 1
    init = lambda *shape: rng.standard_normal(shape).astype(np.float32) / np.float32(shape[-2] ** 0.5)
    share, present = np.zeros((groups, MEMBERS)), np.zeros((groups, MEMBERS), dtype=bool)
    np.add.at(share, (classes.group, classes.member), counts + 0.1)
    present[classes.group, classes.member] = True
    return Weights(
        0.5 * rng.standard_normal((len(classes.group), DIM)).astype(np.float32), init(DIM, DIM), init(DIM, DIM), init(DIM, DIM), (-0.1 * np.arange(2 * SPAN)).astype(np.float32), init(DIM, HIDDEN), init(DIM, HIDDEN), np.zeros(HIDDEN, np.float32),
        init(HIDDEN, groups), np.log(share.sum(axis=1) / share.sum()).astype(np.float32), 0.3 * init(groups, HIDDEN, MEMBERS), np.where(present, np.log(np.maximum(share, 1e-9) / share.sum(axis=1, keepdims=True)), -1e9).astype(np.float32),
    )


def _exps(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exp, sums of rows), both divided by the exp of a row's largest number where rows would leave the range of 32 bits."""
    e, ones = np.exp(logits), np.ones(logits.shape[-1], dtype=np.float32)
    sums = e @ ones
    if not (sums.min() > 1e-30 and sums.max() < 1e30):
        e = np.exp(logits - logits.max(axis=-1, keepdims=True))
        sums = e @ ones
    return e, sums


def descend(weights: Weights, classes: Classes, rows: np.ndarray, passes: int, rate: float, seed: int = 1) -> tuple[Weights, np.ndarray, np.ndarray]:
    """(weights, ids, times) after Adam over the sequences, each in every pass: of the embeddings only those of `ids` have changed, which occur `times`.

    Weights that meet the same inputs lie in one matrix, biases as the last row of it, and all but the embeddings in one vector. Attention is kept as plain exps
    until it has met the values and a column of ones: the divisor then goes to the narrow sides of the products.
    """
    rng, groups = np.random.default_rng(seed), len(weights.b2)
    often = np.zeros(GAP + 1, dtype=np.int64)
    for a in range(0, len(rows), COUNTED * CHUNK):  # bincount() makes eight bytes of each id
        often += np.bincount(rows[a : a + COUNTED * CHUNK, :-1].ravel(), minlength=GAP + 1)
    known = np.flatnonzero(often)
    place = np.zeros(GAP + 1, dtype=np.uint16)
    place[known] = np.arange(len(known))
    small, times, real_ids = place[rows[:, :-1]], often[known], known != GAP
    table, means = np.zeros((len(known), DIM), dtype=np.float32), np.zeros((len(known), 2, DIM), dtype=np.float32)
    table[real_ids] = weights.e[known[real_ids]]
    gap = len(known) - 1 if len(known) and not real_ids[-1] else -1
    spot, seen = np.zeros(len(known), dtype=np.int64), np.zeros(len(known), dtype=bool)
    of_group, of_member = np.full(GAP + 1, groups, dtype=np.int16), np.zeros(GAP + 1, dtype=np.int64)
    of_group[: len(classes.group)], of_member[: len(classes.group)] = classes.group, classes.member

    parts = {
        "q": weights.q, "kv": np.concatenate([weights.k, weights.v], axis=1), "far": weights.far, "hidden": np.concatenate([weights.x, weights.c, weights.b[None]]),
        "out": np.concatenate([weights.out, weights.b2[None]]), "sub": np.concatenate([weights.sub, weights.b3[:, None]], axis=1),
    }
    flat = np.concatenate([a.ravel() for a in parts.values()]).astype(np.float32)
    grad, one, two = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    at = np.cumsum([0] + [a.size for a in parts.values()]).tolist()
    views = lambda x: {n: x[low:high].reshape(a.shape) for (n, a), low, high in zip(parts.items(), at, at[1:], strict=False)}
    p, g = views(flat), views(grad)
    step, steps, scale = 0, max(1, passes * -(-len(rows) // STEP)), np.float32(DIM**-0.5)
    columns, blocked = np.arange(DIM), np.where(CAUSAL, np.float32(0), np.float32(-1e9))

    def adam(x: np.ndarray, dx: np.ndarray, one: np.ndarray, two: np.ndarray, now: np.float32) -> None:
        one += np.float32(0.1) * (dx - one)
        np.multiply(dx, dx, out=dx)
        dx -= two
        dx *= np.float32(0.01)
        two += dx
        root = np.sqrt(two / np.float32(1 - 0.99**step))
        root += np.float32(1e-8)
        x -= (now / np.float32(1 - 0.9**step)) * one / root

    for _ in range(passes):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), STEP):
            pick = order[a : a + STEP]
            z, n = small[pick].astype(np.int64), len(pick)
            # forward
            e = table.take(z.ravel(), axis=0)
            eq = e.reshape(n, 2 * SPAN, DIM)[:, SPAN:].reshape(-1, DIM)
            kv = np.empty((n, 2 * SPAN, 2 * DIM + 1), dtype=np.float32)
            np.matmul(e, p["kv"], out=kv.reshape(-1, 2 * DIM + 1)[:, :-1])
            kv[..., -1] = 1
            k, v = kv[..., :DIM], kv[..., DIM:]  # v with a one that adds up the weights
            q = (eq @ p["q"] * scale).reshape(n, SPAN, DIM)
            s = q @ k.transpose(0, 2, 1)
            s += p["far"][DISTANCE] + blocked
            gaps = z == gap
            if len(holes := np.flatnonzero(gaps.any(axis=1))):
                s[holes] -= np.float32(1e9) * gaps[holes, None, :]
            att = np.exp(s)
            c = att @ v
            if not (c[..., -1].min() > 1e-30 and c[..., -1].max() < 1e30):
                att = np.exp(s - s.max(axis=2, keepdims=True))
                c = att @ v
            c, share = c[..., :-1].reshape(-1, DIM), 1 / c[..., -1].reshape(-1, 1)
            c *= share
            into = np.empty((n * SPAN, 2 * DIM + 1), dtype=np.float32)
            into[:, :DIM], into[:, DIM:-1], into[:, -1] = eq, c, 1
            r = np.empty((n * SPAN, HIDDEN + 1), dtype=np.float32)
            np.maximum(into @ p["hidden"], 0, out=r[:, :-1])
            r[:, -1] = 1
            # targets in the order of their groups; those that are none come last and are left out
            y = rows[pick, SPAN + 1 :].ravel()
            group = of_group[y]
            by = np.argsort(group, kind="stable")
            bounds = np.searchsorted(group[by], np.arange(groups + 1)).tolist()
            by = by[: bounds[-1]]
            if not len(by):
                continue
            group, member, each, per = group[by], of_member[y[by]], np.arange(len(by)), np.float32(1 / len(by))
            some = r.take(by, axis=0)
            d, sums = _exps(some @ p["out"])
            d *= (per / sums)[:, None]
            d[each, group] -= per
            np.matmul(some.T, d, out=g["out"])
            dr = d @ p["out"].T
            spans = [(j, low, high) for j, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)) if low < high]
            logits = np.empty((len(by), MEMBERS), dtype=np.float32)
            for j, low, high in spans:
                np.matmul(some[low:high], p["sub"][j], out=logits[low:high])
            d, sums = _exps(logits)
            d *= (per / sums)[:, None]
            d[each, member] -= per
            g["sub"][:] = 0
            for j, low, high in spans:
                np.matmul(some[low:high].T, d[low:high], out=g["sub"][j])
                dr[low:high] += d[low:high] @ p["sub"][j].T
            # backward
            du = np.zeros((n * SPAN, HIDDEN), dtype=np.float32)
            du[by] = dr[:, :-1]
            du *= r[:, :-1] > 0
            np.matmul(into.T, du, out=g["hidden"])
            back = du @ p["hidden"][:-1].T
            dc = np.empty((n * SPAN, DIM + 1), dtype=np.float32)
            dc[:, :-1] = back[:, DIM:]
            dc[:, -1] = -np.einsum("ij,ij->i", back[:, DIM:], c)
            dc *= share
            dc = dc.reshape(n, SPAN, DIM + 1)
            ds = dc @ v.transpose(0, 2, 1)
            ds *= att
            dkv = np.empty((n, 2 * SPAN, 2 * DIM), dtype=np.float32)
            np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :DIM])
            np.matmul(att.transpose(0, 2, 1), dc[..., :-1], out=dkv[..., DIM:])
            dq = (ds @ k).reshape(-1, DIM)
            dq *= scale
            g["far"][:] = np.bincount(DISTANCE.ravel(), weights=ds.sum(axis=0).ravel(), minlength=2 * SPAN)
            np.matmul(eq.T, dq, out=g["q"])
            dkv = dkv.reshape(-1, 2 * DIM)
            np.matmul(e.T, dkv, out=g["kv"])
            de = (dkv @ p["kv"].T).reshape(n, 2 * SPAN, DIM)
            de[:, SPAN:] += (dq @ p["q"].T + back[:, :DIM]).reshape(n, SPAN, DIM)
            # embeddings change in the rows that occur in this step
            seen[z] = True
            here = np.flatnonzero(seen)
            seen[here], spot[here] = False, np.arange(len(here))
            sums = np.bincount((spot[z.ravel()][:, None] * DIM + columns).ravel(), weights=de.ravel(), minlength=len(here) * DIM)
            step += 1
            now = np.float32(rate * (1 - step / (steps + 1)) + 0.05 * rate)
            adam(flat, grad, one, two, now)
            some, mean = table.take(here, axis=0), means.take(here, axis=0)
            adam(some, sums.reshape(-1, DIM).astype(np.float32), mean[:, 0], mean[:, 1], now)
            table[here], means[here] = some, mean
    ids = known[real_ids]
    e = weights.e.copy()
    e[ids] = table[real_ids]
    return Weights(e, p["q"], *np.split(p["kv"], 2, axis=1), p["far"], p["hidden"][:DIM], p["hidden"][DIM:-1], p["hidden"][-1], p["out"][:-1], p["out"][-1], p["sub"][:, :-1], p["sub"][:, -1]), ids, times[real_ids]


def begun(rows: np.ndarray, classes: Classes, counts: np.ndarray) -> Weights:
    """Weights after PASSES over a bounded number of sequences; ids that do not occur get their group's mean embedding."""
    weights, ids, _ = descend(first_weights(classes, counts), classes, rows, PASSES, 0.01)
    own, groups = classes.group[ids], len(weights.b2)
    sums = np.zeros((groups, DIM))
    np.add.at(sums, own, weights.e[ids])
    table = (sums / np.maximum(np.bincount(own, minlength=groups), 1)[:, None])[classes.group].astype(np.float32)
    table[ids] = weights.e[ids]
    return weights._replace(e=table)


def train(texts: list[np.ndarray], classes: Classes, seed: int = 1) -> Weights:
    """Weights from a seeded choice of FIT_WINDOWS windows of texts."""
    rows, counts = sequences(texts, len(classes.group) - 1), np.zeros(len(classes.group))
    for t in texts:
        np.add.at(counts, t, 1)
    counts[-1] = len(texts)
    return begun(rows[np.random.default_rng(seed).permutation(len(rows))[:FIT_WINDOWS]], classes, counts)


# --- corpus ----------------------------------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts (one column). Words are counted by ranges of texts first, so few rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ranges(batch.column(0), 1 << 24):
                words = words_of(batch.column(0).slice(a, b - a), lower=True)
                yield pa.RecordBatch.from_arrays([words.unique, pa.array(np.bincount(words.codes, minlength=len(words.unique)), pa.int64())], ["word", "c"])

    return texts.mapInArrow(lean(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count such that at most `most` words (most // 2 or more, if counts are fine enough) have it or more. From a histogram with 16 bins per power of two."""
    bins = counts.groupBy(F.floor(F.log2("c") * 16).alias("bin")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("bin")).collect()
    total, least = 0, 1 << 62
    for r in bins:
        total += r["n"]
        if total > most:
            break
        least = r["c"]
    return least


class Counts(NamedTuple):
    """Of the training texts: the most frequent words and how often they occur, all words and ends, distinct ones, and ends alone."""

    frequent: pa.Array
    many: np.ndarray
    total: int
    vocabulary: int
    ends: int

    @property
    def floor(self) -> int:
        return self.total + (self.vocabulary + 1)


def corpus_counts(counts: DataFrame, ends: int) -> Counts:
    distinct, words = counts.agg(F.count("*"), F.sum("c")).first()
    found = counts.where(F.col("c") >= _least_count(counts, HEAD)).toArrow()
    return Counts(found.column("word").combine_chunks(), np.append(found.column("c").to_numpy(), 0).astype(np.float64), (words or 0) + ends, distinct + (ends > 0), ends)


def tokenized(rows: DataFrame, tokenizer: str, counts: Counts) -> DataFrame:
    """rows (uid, doc_id, text, held_out) with each text split once, for training and scoring: its ids, how many each word has (_packed()), each word's place among
    the frequent ones (-1: none), its other words (tail), and base, the sum over the frequent ones."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)  # HEAD words: a fixed bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords, known = loaded(tokenizer), shared.value
        base_of = np.append(np.log10((known.many[:-1] + 1) / known.floor), 0.0)
        for batch in batches:
            texts = batch.column(2)
            for a, b in ranges(texts):
                found = words_of(texts.slice(a, b - a), lower=True)
                ids, ends = subwords.of_words(found)
                cuts = np.concatenate([[0], ends])
                at = pc.index_in(found.unique, value_set=known.frequent).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)[found.codes]
                unknown = at < 0
                sizes, size_ends = _packed(np.diff(cuts))
                tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(unknown)])[found.bounds], pa.int32()), found.unique.take(pa.array(found.codes[unknown])))
                base = np.concatenate([[0.0], np.cumsum(base_of[at])])[found.bounds]
                columns = [_binaries(ids, cuts[found.bounds]), _binaries(sizes, size_ends[found.bounds]), _binaries(at, found.bounds), tail, pa.array(np.diff(base))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 1, 3)), *columns], ["uid", "doc_id", "held_out", "ids", "sizes", "at", "tail", "base"])

    return rows.select("uid", "doc_id", "text", "held_out").mapInArrow(lean(run), "uid long, doc_id long, held_out boolean, ids binary, sizes binary, at binary, tail array<string>, base double")


def _packed(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): each size as so many bytes 255 and one that is less, whose sum it is; where each begins, and the end."""
    ends = np.cumsum(sizes // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, dtype=np.uint8)
    out[ends - 1] = sizes % 255
    return out, np.concatenate([[0], ends])


def _unpacked(sizes: np.ndarray) -> np.ndarray:
    """Where the parts of these sizes begin, and the end."""
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)[sizes < 255]])


def _binaries(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Parts of an array as bytes, one value for each part."""
    flat = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])


def _flat(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all values in turn, how many each has): what _binaries() made."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) // np.dtype(dtype).itemsize
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]].copy().view(dtype), sizes


def _ids(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column(column):
            if len(ids := np.frombuffer(x.as_py(), dtype=np.uint16)):
                yield ids


def id_counts(training: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in the corpus (ids of each text). One sum per id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for a, b in ranges(batch.column(0)):
                sums += np.bincount(_flat(batch.column(0).slice(a, b - a), np.uint16)[0], minlength=size)
        ids = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums[ids])], ["id", "n"])

    out = np.zeros(size, dtype=np.float64)
    for r in training.select("ids").mapInArrow(lean(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def training_windows(training: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """(key, rows): all sequences (see sequences()) of all training texts (uid, and ids or text), so that every token is a target once; texts without words have none."""
    ready = "ids" in training.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, texts = batch.column(0).to_numpy(), batch.column(1)
            for a, b in ranges(texts):
                if ready:
                    ids = list(_ids([batch.slice(a, b - a)], 1))
                else:
                    flat, bounds = split(texts.slice(a, b - a), lower=True)
                    found, id_ends = loaded(tokenizer).of_words(encoded(flat, bounds))
                    cuts = np.concatenate([[0], id_ends])[bounds].tolist()
                    ids = [found[low:high] for low, high in zip(cuts[:-1], cuts[1:], strict=True) if high > low]
                if not ids:
                    continue
                rows = sequences(ids, end)
                parts = [rows[k : k + CHUNK] for k in range(0, len(rows), CHUNK)]
                yield pa.RecordBatch.from_arrays([pa.array([int(uids[a]) * 1000 + k for k in range(len(parts))], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["key", "rows"])

    return training.select("uid", "ids" if ready else "text").mapInArrow(lean(run), "key long, rows binary")


def _rows(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.uint16).reshape(-1, 2 * SPAN + 1)


def _blocks(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[np.ndarray]:
    """The sequences of `size` rows of the windows' table at a time, so that a task holds no more of them however large its partition is."""
    some: list[bytes] = []
    for batch in batches:
        for x in batch.column(column):
            some.append(x.as_py())
            if len(some) == size:
                yield np.concatenate([_rows(b) for b in some])
                some = []
    if some:
        yield np.concatenate([_rows(b) for b in some])


def _ids_blocks(batches: Iterator[pa.RecordBatch], end: int, size: int) -> Iterator[np.ndarray]:
    """The sequences of texts' ids, size * CHUNK or fewer at a time; a text of more is cut, and its sequences are the same as if it were not."""
    some: list[np.ndarray] = []
    held, most = 0, size * CHUNK
    for ids in _ids(batches, 0):
        n = -(-(len(ids) + 1) // SPAN)
        if some and held + n > most:
            yield sequences(some, end)
            some, held = [], 0
        if n > most:
            rows = sequences([ids], end)
            yield from (rows[k : k + most] for k in range(0, n, most))
        else:
            some.append(ids)
            held += n
    if some:
        yield sequences(some, end)


def _source(table: DataFrame, end: int) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch], int], Iterator[np.ndarray]]]:
    """The column of a table that holds windows (see training_windows()) or texts' ids, and what makes blocks of windows from it."""
    if "ids" in table.columns:
        return table.select("ids"), lambda batches, size: _ids_blocks(batches, end, size)
    return table.select("rows"), lambda batches, size: _blocks(batches, 0, size)


def corpus_contexts(table: DataFrame, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """contexts() of all training windows: sums per block of windows, then per key, of which there are 2 * marks for each id at most."""
    column, blocks = _source(table, int(marks[0]))  # the end is the first mark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(batches, COUNTED):
            keys, times = contexts(rows, marks)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["key", "n"])

    found = column.mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys = found.column("key").to_numpy()
    order = np.argsort(keys)
    return keys[order], found.column("n").to_numpy()[order]


class Gathered:
    """What partitions changed: sums of changes, weighted by windows, and of embeddings, weighted by how often their id occurs."""

    def __init__(self, size: int):
        self.n, self.dense = 0, [0.0] * (len(Weights._fields) - 1)
        self.times, self.e = np.zeros(size), np.zeros((size, DIM), dtype=np.float32)

    def add(self, blob: bytes) -> None:
        n, dense, ids, times, e = pickle.loads(blob)
        self.n, self.dense = self.n + n, [x + y for x, y in zip(self.dense, dense, strict=True)]
        self.times[ids] += times
        self.e[ids] += e

    def blob(self) -> bytes:
        ids = np.flatnonzero(self.times)
        return pickle.dumps((self.n, self.dense, ids.astype(np.uint16), self.times[ids], self.e[ids]))

    def applied(self, weights: Weights) -> Weights:
        if not self.n:
            return weights
        e = weights.e + self.e / np.maximum(self.times, 1)[:, None].astype(np.float32)
        return Weights(e, *((w + d / np.float32(self.n)).astype(np.float32) for w, d in zip(weights[1:], self.dense, strict=True)))


def averaged(table: DataFrame, weights: Weights, classes: Classes, round_: int) -> Weights:
    """The mean of the weights that all partitions of the windows reach from `weights`, each by a pass over its own windows,
    blocks of TRAINED * CHUNK windows after another.

    The changes are added up in tasks, FAN of them in each, until FAN are left for the driver.
    """
    spark, size = table.sparkSession, len(classes.group)
    column, blocks = _source(table, size - 1)
    shared = spark.sparkContext.broadcast((weights, classes))  # DIM floats and two numbers per id: a fixed bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own, classes = shared.value
        after, n, times = own, 0, np.zeros(size)
        for rows in blocks(batches, TRAINED):
            after, ids, some = descend(after, classes, rows, 1, 0.004, seed=round_)
            times[ids] += some
            n += len(rows)
        if n:
            ids = np.flatnonzero(times)
            change = (n, [n * (x - y) for x, y in zip(after[1:], own[1:], strict=True)], ids.astype(np.uint16), times[ids], (after.e[ids] - own.e[ids]) * times[ids, None].astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(change)], pa.binary())], ["change"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Gathered(size)
        for batch in batches:
            for x in batch.column(0):
                sums.add(x.as_py())
        if sums.n:
            yield pa.RecordBatch.from_arrays([pa.array([sums.blob()], pa.binary())], ["change"])

    changes, path = kept(column.mapInArrow(lean(run), "change binary"), "lm-changes")
    while (many := changes.count()) > FAN:
        last = path
        changes, path = kept(changes.repartition(-(-many // FAN)).mapInArrow(lean(add), "change binary"), "lm-changes")
        delete(spark, last)
    total = Gathered(size)
    for r in changes.toLocalIterator():
        total.add(bytes(r["change"]))
    delete(spark, path)
    shared.unpersist()
    return total.applied(weights)


def fit(training: DataFrame, counts: np.ndarray, tokenizer: str) -> tuple[Classes, Weights] | None:
    """Classes and weights from all training texts (uid, ids); counts: of ids in the whole corpus. None without words."""
    table = training_windows(training, tokenizer, len(counts) - 1)
    order = [F.xxhash64("key"), F.col("key")]
    chosen = [r["key"] for r in table.select("key").orderBy(*order).limit(-(-FIT_WINDOWS // CHUNK)).collect()]  # keys alone, since each task sends as many
    if not chosen:
        return None
    first = table.where(F.col("key").isin(chosen)).orderBy(*order).collect()
    marks = make_marks(counts)
    classes = classes_of(counts, *corpus_contexts(training, marks), len(marks))
    weights = begun(np.concatenate([_rows(bytes(r["rows"])) for r in first])[:FIT_WINDOWS], classes, counts)
    for k in range(ROUNDS):
        weights = averaged(training, weights, classes, k)
    return classes, weights


def score(docs: DataFrame, text: str = "text", folds: int = 7, held: int = 2, tokenizer: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Held out are documents whose crc32(doc_id) modulo folds is `held`. All others teach: the words' counts (baseline), the subword
    ids' counts, their classes, and the attention weights, which windows of every document train: a start on a bounded number
    of windows, then rounds in which each partition trains on all its windows and the results are averaged. A word's
    probability is the model's (the product over its ids) mixed with its share in the corpus (BLEND); score sums the logarithms. A
    word's count is at hand if it is among the most frequent ones (HEAD at most), else it is joined, so the vocabulary may grow
    without bound. Null and empty texts are an end alone; repeated rows count and are scored one by one; null doc_ids are
    training rows (crc of the empty text) unless that is held out; extra columns are ignored; long texts are scored in blocks of
    windows; an empty table gives an empty result.
    """
    docs = stored_rows(docs)
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    rows = with_uid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), (crc_mod("doc_id", folds) == held).alias("held_out"))).select("uid", "doc_id", "text", "held_out")
    training = rows.where("not held_out")
    counts = stash(word_counts(training.select("text")), "lm-counts")
    known = corpus_counts(counts, training.count())
    table = stash(tokenized(rows, tokenizer, known), "lm-ids")
    learned, size = table.where("not held_out").select("uid", "ids"), loaded(tokenizer).tokenizer.get_vocab_size() + 1
    by_id = id_counts(learned, size)
    total, ends, floor = known.total, known.ends, known.floor
    by_id[size - 1] = ends
    model = fit(learned, by_id, tokenizer)
    shared = Shared(uuid.uuid4().hex, spark.sparkContext.broadcast((known.many, model)))  # HEAD numbers, and DIM floats per id: a fixed bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.id not in _ready:  # once a worker
            forget()
            many, model = shared.value
            _ready.clear()
            _ready[shared.id] = many, Scorer(model[1], model[0]) if model else None
        many, scorer = _ready[shared.id]

        for batch in batches:
            for a, b in ranges(batch.column(3), SCORED):
                part = batch.slice(a, b - a)
                (ids, n_ids), (sizes, _), (at, n) = (_flat(part.column(i), t) for i, t in ((3, np.uint16), (4, np.uint8), (5, np.int32)))
                cuts, bounds = _unpacked(sizes), np.concatenate([[0], np.cumsum(n)])
                unknown, c = at < 0, many[at]
                if scorer:
                    limits = np.concatenate([[0], np.cumsum(n_ids)])
                    ln = scorer.token_scores(*windows([ids[x:y] for x, y in zip(limits, limits[1:], strict=False)], scorer.end))
                    along = np.concatenate([[0.0], np.cumsum(ln)])
                    of = np.repeat(np.arange(b - a), n)  # ends stand between the texts
                    own = along[cuts[1:] + of] - along[cuts[:-1] + of]
                    last = along[limits[1:] + np.arange(b - a) + 1] - along[limits[1:] + np.arange(b - a)]
                else:
                    own, last = np.full(len(at), -np.log(floor + 1)), np.full(b - a, -np.log(floor + 1))
                with np.errstate(divide="ignore"):  # the logarithm of no count
                    blended, score = (np.logaddexp(np.log(1 - BLEND) + x, np.log(BLEND * times / max(1, total))) / LN10 for x, times in ((own, c), (last, np.full(b - a, float(ends)))))
                score += np.diff(np.concatenate([[0.0], np.cumsum(np.where(unknown, 0.0, blended))])[bounds])
                rare = np.concatenate([[0], np.cumsum(unknown)])[bounds]
                tail_ln = pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(own[unknown].astype(np.float32)))
                base = part.column(7).to_numpy() + np.log10((ends + 1) / floor)
                columns = [*(part.column(i) for i in range(3)), pa.array(n.astype(np.int64) + 1), pa.array(n - np.diff(rare) + (ends > 0)), pa.array(base), part.column(6), tail_ln, pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "tail", "tail_ln", "score"])
            pa.default_memory_pool().release_unused()

    done = stash(table.mapInArrow(lean(run), "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, tail array<string>, tail_ln array<float>, score double"), "lm-scored")
    tail = done.where(F.size("tail") > 0).select("uid", F.explode(F.arrays_zip("tail", "tail_ln")).alias("t")).select("uid", F.col("t.tail").alias("word"), F.col("t.tail_ln").cast("double").alias("ln"))
    c, model_ln = F.coalesce("c", F.lit(0)), F.col("ln") + float(np.log(1 - BLEND))
    apart = F.log(BLEND * c / F.lit(float(max(1, total)))) - model_ln
    mixed = (F.when(c == 0, model_ln).otherwise(F.greatest(model_ln, model_ln + apart) + F.log1p(F.exp(-F.abs(apart))))) / LN10
    joined = tail.join(counts, "word", "left").groupBy("uid").agg(F.count("c").alias("known"), F.sum(F.log10((c + 1) / F.lit(float(floor)))).alias("rest"), F.sum(mixed).alias("more"))
    return done.drop("tail", "tail_ln").join(joined, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")
    )
