"""Language identification by unigram models of subword pieces, summed over all segmentations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Recent, crc_mod, kept, lean, scratch
from gleanery.llm.words import Words, ranges, words_of

#: A run of letters with their marks; what stands between runs says nothing here.
RUN = regex.compile(r"\p{L}[\p{L}\p{M}]*")
START = "▁"
#: What often stands at a word's ends and is no letter: taken away before words are told apart.
ENDS = ".,;:!?…\"'`´’‘“”«»()[]{}<>|/\\*_-–—+=~#&%$@0123456789"
#: Passes of expectation and maximization, and what every piece has besides its expected count.
ROUNDS, ALPHA = 3, 0.05
#: Languages scored in one pass: bounds what is sent to all (LANGUAGES times the vocabulary, 8 bytes each); more take more passes.
LANGUAGES = 64
#: Letters that are segmented at once, words whose scores a worker keeps, and bytes of text that are scored at once.
CELLS, CACHED, BYTES = 200_000, 250_000, 1 << 20
#: Expected counts are whole multiples of a UNIT-th, so that their sums don't depend on partitioning (up to 2^53 units in a group of words).
UNIT = 1 << 16
UNKNOWN = "und"

_loaded: dict[str, "Pieces"] = {}
_caches: dict[str, Recent] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_at(path: str) -> "Pieces":
    """The worker's own, kept between tasks."""
    if path not in _loaded:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        _loaded[path] = Pieces([model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))])
    return _loaded[path]


class Edges(NamedTuple):
    ids: np.ndarray  # (length - 1, word, start): the piece that begins there, from `size` on a letter by its bytes, or -1
    spelled: list[bytes]  # those letters
    lengths: np.ndarray  # of the words
    order: np.ndarray  # the words' places in what was asked


class Pieces:
    """Pieces of lower-case letters from a vocabulary, and 256 bytes for letters that have no piece. A word begins with START."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        plain = sorted({p for p in pieces if p == p.lower() and all(regex.fullmatch(r"[\p{L}\p{M}]", c) for c in p.removeprefix(START)) and p} | {START})
        self.pieces, self.size = [*plain, *(f"<0x{b:02X}>" for b in range(256))], len(plain) + 256
        self.bytes_at, self.longest = len(plain), max(map(len, plain))
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, self.BASE)]), dtype=np.uint64)
        self.by_length = []
        for length in range(1, self.longest + 1):
            own = [(self._hash(p), i) for i, p in enumerate(plain) if len(p) == length]
            keys, ids = np.array([h for h, _ in own], dtype=np.uint64), np.array([i for _, i in own], dtype=np.int32)
            at = np.argsort(keys)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces have one hash")
            there = np.zeros(1 << 20, dtype=bool)  # by the first bits of the hash: most parts of words are no pieces
            there[keys >> np.uint64(44)] = True
            self.by_length.append((keys[at], ids[at], there))

    def _hash(self, piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * int(self.BASE) + ord(c) + 1) % (1 << 64)
        return value

    def edges(self, words: list[str]) -> Iterator[Edges]:
        """All pieces at all places of the words, in groups of like lengths, some CELLS letters each (one word at least)."""
        points = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), dtype="<u4")
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        low = 0
        while low < len(order):
            wide = int(lengths[order[low]])
            most = max(1, CELLS // wide)
            shorter = int(np.searchsorted(-lengths[order], -(wide // 2), side="left"))  # a group's shortest word has over half the letters of its longest
            high = min(len(order), low + most, max(low + 1, shorter))
            yield self._group(points, starts[order[low:high]], lengths[order[low:high]], order[low:high])
            low = high

    def _group(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> Edges:
        wide = int(lengths[0])
        inside = np.arange(wide) < lengths[:, None]
        letters = np.zeros((len(starts), wide), dtype=np.uint64)
        letters[inside] = points[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        sums = np.zeros((len(starts), wide + 1), dtype=np.uint64)
        for k in range(wide):
            sums[:, k + 1] = sums[:, k] * self.BASE + letters[:, k] + np.uint64(1)
        ids = np.full((min(self.longest, wide), len(starts), wide), -1, dtype=np.int32)
        for length in range(1, len(ids) + 1):
            keys, of, there = self.by_length[length - 1]
            if len(keys):
                hashes = sums[:, length:] - sums[:, : wide + 1 - length] * self.powers[length]
                row, start = np.nonzero(there[hashes >> np.uint64(44)] & inside[:, length - 1 :])
                found = hashes[row, start]
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                same = np.flatnonzero(keys[at] == found)
                ids[length - 1, row[same], start[same]] = of[at[same]]
        strange = inside & (ids[0] < 0)
        spelled, code = np.unique(letters[strange], return_inverse=True)
        ids[0][strange] = self.size + code
        return Edges(ids, [chr(c).encode("utf-8", "surrogatepass") for c in spelled.tolist()], lengths, order)

    def table(self, edges: Edges, logs: np.ndarray) -> np.ndarray:
        """logs (piece, language), with a row for each letter that is spelled."""
        return np.concatenate([logs, *(logs[[self.bytes_at + b for b in c]].sum(axis=0, keepdims=True) for c in edges.spelled)])


def steps(edges: Edges) -> Iterator[tuple[int, int]]:
    """(start, end) for which some word has a piece, by end."""
    there = (edges.ids >= 0).any(axis=1)
    for end in range(1, there.shape[1] + 1):
        for length in (np.flatnonzero(there[np.arange(min(len(there), end)), end - 1 - np.arange(min(len(there), end))]) + 1).tolist():
            yield end - length, end


def forward(edges: Edges, value) -> np.ndarray:
    """(end, word, language): log of the summed probability of all segmentations up to each place. value(rows, ids): logs of pieces."""
    out = None
    for start, end in steps(edges):
        found = edges.ids[end - start - 1, :, start]
        rows = np.flatnonzero(found >= 0)
        add = value(rows, found[rows])
        if out is None:
            out = np.full((edges.ids.shape[2] + 1, edges.ids.shape[1], add.shape[1]), -np.inf)
            out[0] = 0.0
        out[end, rows] = np.logaddexp(out[end, rows], out[start, rows] + add)
    return out


def word_logs(pieces: Pieces, words: list[str], logs: np.ndarray) -> np.ndarray:
    """(word, language): log probability of each word, summed over all its segmentations. logs: (piece, language)."""
    out = np.zeros((len(words), logs.shape[1]))
    for edges in pieces.edges(words):
        table = pieces.table(edges, logs)
        sums = forward(edges, lambda rows, ids, table=table: table[ids])
        out[edges.order] = sums[edges.lengths, np.arange(len(edges.lengths))]
    return out


def expected(pieces: Pieces, words: list[str], langs: np.ndarray, times: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """(piece, language): how often each piece is expected in the words, each under its own language, `times` each, in UNITs: forward and backward sums."""
    total = np.zeros(logs.shape, dtype=np.int64)
    for edges in pieces.edges(words):
        table, lang, n = pieces.table(edges, logs), langs[edges.order], times[edges.order]
        value = lambda rows, ids, table=table, lang=lang: table[ids, lang[rows]][:, None]
        ahead = forward(edges, value)[:, :, 0]
        each = np.arange(len(lang))
        back = np.full_like(ahead, -np.inf)
        back[edges.lengths, each] = 0.0
        whole, flat, weights = ahead[edges.lengths, each], [], []
        for start, end in reversed(list(steps(edges))):
            found = edges.ids[end - start - 1, :, start]
            rows = np.flatnonzero(found >= 0)
            logp = value(rows, found[rows])[:, 0] + back[end, rows]
            back[start, rows] = np.logaddexp(back[start, rows], logp)
            flat.append(found[rows].astype(np.int64) * logs.shape[1] + lang[rows])
            weights.append(np.rint(np.exp(ahead[start, rows] + logp - whole[rows]) * n[rows] * UNIT))
        sums = np.bincount(np.concatenate(flat), weights=np.concatenate(weights), minlength=table.size).reshape(table.shape).astype(np.int64)
        total += sums[: len(logs)]
        for k, c in enumerate(edges.spelled):
            np.add.at(total, [pieces.bytes_at + b for b in c], sums[len(logs) + k])
    return total


def folded(words: Words) -> tuple[pa.Array, np.ndarray]:
    """(distinct, codes): the texts' words in lower case without ENDS, and which of them each word is."""
    found = pc.utf8_trim(pc.utf8_lower(words.unique), characters=ENDS).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False)[words.codes] if len(words.codes) else words.codes


def runs(words: pa.Array) -> tuple[np.ndarray, dict[int, list[str]]]:
    """(plain, others): which folded words are one run of letters, and the runs of each other word."""
    plain = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
    rest = np.flatnonzero(~plain)
    return plain, dict(zip(rest.tolist(), map(RUN.findall, words.take(pa.array(rest)).to_pylist()), strict=True))


def word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, run, n): how often each run of letters stands in the texts of a language. Counted in each task before the shuffle."""

    def counted(texts: pa.Array, name: str) -> pa.RecordBatch:
        words, codes = folded(words_of(texts))
        times = np.bincount(codes, minlength=len(words))
        plain, others = runs(words)
        found: Counter = Counter()
        for i, parts in others.items():
            for r in parts:
                found[r] += int(times[i])
        alone = np.flatnonzero(plain)
        run = pa.concat_arrays([words.take(pa.array(alone)), pa.array(list(found), pa.string())])
        n = np.concatenate([times[alone], np.fromiter(found.values(), dtype=np.int64, count=len(found))]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(run), pa.string()), run, pa.array(n)], ["lang", "run", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in ranges(batch.column(1)):
                part = batch.slice(low, high - low)
                names = part.column(0).dictionary_encode()
                for code, name in enumerate(names.dictionary.to_pylist()):
                    yield counted(part.column(1).filter(pc.equal(names.indices, code)), name)

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "lang string, run string, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    path: str  # of the vocabulary
    languages: list[str]  # by code points
    blocks: list[np.ndarray]  # log probabilities (piece, language), LANGUAGES languages each


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", path: str | None = None, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of each language that docs name, from the words of all their texts, by expectation and maximization over all segmentations.

    Each round is one pass over the distinct words; tasks send their sums by piece and language, LANGUAGES languages at a
    time. The driver holds one number for each piece and language. Rows without text or lang teach nothing.
    """
    spark, path = docs.sparkSession, path or default_vocabulary()
    pieces = pieces_at(path)
    with scratch(spark):
        counts, _ = kept(word_counts(docs, text, lang), "language-words")
        names = sorted((r["lang"] for r in counts.select("lang").distinct().collect()), key=str.encode)
        blocks = [_fitted(counts, names[k : k + LANGUAGES], pieces, path, rounds) for k in range(0, len(names), LANGUAGES)]
    return Model(path, names, blocks)


def _fitted(counts: DataFrame, names: list[str], pieces: Pieces, path: str, rounds: int) -> np.ndarray:
    logs = np.full((pieces.size, len(names)), -np.log(pieces.size))
    place = {n: i for i, n in enumerate(names)}
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast(logs)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, now = pieces_at(path), shared.value
            total = np.zeros(now.shape, dtype=np.int64)
            for batch in batches:
                langs = np.array([place[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
                total += expected(own, batch.column(1).to_pylist(), langs, batch.column(2).to_numpy(zero_copy_only=False).astype(float), now)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        sums = counts.where(F.col("lang").isin(names)).select("lang", "run", "n").mapInArrow(lean(run), "piece int, lang int, n long")
        found = sums.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        units = np.zeros(logs.shape, dtype=np.int64)
        units[found["piece"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
        logs = np.log(units / UNIT + ALPHA) - np.log(units.sum(axis=0) / UNIT + ALPHA * len(units))
        shared.unpersist()
    return logs


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs' doc_id with lang_pred and score.

    A text's log probability under a language adds up its words', each summed over all its segmentations; the largest wins
    (the first by code points if several do), and score is its share of all languages' probabilities. Null texts, texts without a
    letter, and a model without languages give `und` and 0. Texts are read whole, of any length; repeated rows and null doc_ids
    stay; equal texts get equal scores. No shuffle; each LANGUAGES languages are one pass.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("double").alias("total"))
    for k, logs in enumerate(model.blocks):
        last = k + 1 == len(model.blocks)  # then the text isn't passed on
        state = "doc_id long, lang_pred string, best double, total double" if last else "doc_id long, text string, lang_pred string, best double, total double"
        rows = rows.mapInArrow(lean(_scorer(docs, logs, model.languages[k * LANGUAGES : (k + 1) * LANGUAGES], model.path, last)), state)
    return rows.select("doc_id", "lang_pred", F.coalesce(F.exp(F.col("best") - F.col("total")), F.lit(0.0)).alias("score"))


def _scorer(docs: DataFrame, logs: np.ndarray, names: list[str], path: str, last: bool):
    shared, token = docs.sparkSession.sparkContext.broadcast(logs), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, now, wide = pieces_at(path), shared.value, len(names) + 1
        if token not in _caches:  # the worker's own, for one model at a time
            _caches.clear()
            _caches[token] = Recent(CACHED)
        cache = _caches[token]
        for batch in batches:
            for low, high in ranges(batch.column(1), BYTES):
                part = batch.slice(low, high - low)
                words = words_of(part.column(1))
                unique, codes = folded(words)
                bodies = unique.to_pylist()
                new = list(cache.missing(set(bodies)))
                cache.young.update(_learned(pieces, new, now))
                each = np.frombuffer(b"".join(map(cache.young.__getitem__, bodies)), dtype=float).reshape(-1, wide)[codes]
                sums = np.zeros((len(part), wide))
                some = np.flatnonzero(np.diff(words.bounds))
                if len(some):
                    sums[some] = np.add.reduceat(each, words.bounds[some], axis=0)
                letters = sums[:, 0] > 0
                at = sums[:, 1:].argmax(axis=1)
                best, total = sums[np.arange(len(part)), 1 + at], np.logaddexp.reduce(sums[:, 1:], axis=1)
                old = part.column(3).to_numpy(zero_copy_only=False)
                better = letters & ~(old >= best)  # the first block's old is null
                seen = part.column(4).to_numpy(zero_copy_only=False)
                total = np.where(np.isnan(seen), total, np.logaddexp(np.where(np.isnan(seen), -np.inf, seen), total))
                pred = [names[i] if b else o for i, b, o in zip(at.tolist(), better.tolist(), part.column(2).to_pylist(), strict=True)]
                columns = {"doc_id": part.column(0), "text": part.column(1), "lang_pred": pa.array(pred, pa.string()), "best": pa.array(np.where(better, best, old), mask=~letters), "total": pa.array(total, mask=~letters)}
                yield pa.RecordBatch.from_pydict({k: v for k, v in columns.items() if not (last and k == "text")})

    return run


def _learned(pieces: Pieces, words: list[str], logs: np.ndarray) -> dict[str, bytes]:
    """Of each folded word: the number of its runs, and the sum of their logs, as bytes."""
    plain, others = runs(pa.array(words, pa.string()))
    alone = np.flatnonzero(plain).tolist()
    flat = list(dict.fromkeys([*(words[i] for i in alone), *(r for parts in others.values() for r in parts)]))
    each = word_logs(pieces, flat, logs)
    out = np.zeros((len(words), logs.shape[1] + 1))
    out[alone, 0] = 1.0
    out[alone, 1:] = each[: len(alone)]  # words are distinct, so these come first and in order
    place = {r: i for i, r in enumerate(flat)} if others else {}
    for i, parts in others.items():
        out[i, 0] = len(parts)
        for r in parts:
            out[i, 1:] += each[place[r]]
    data, size = out.tobytes(), 8 * out.shape[1]
    return {w: data[i * size : (i + 1) * size] for i, w in enumerate(words)}


def predict(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the model is fitted on rows whose crc32(doc_id) mod 3 is not 1, and reads nothing but their text and lang."""
    held = crc_mod("doc_id", 3) == 1
    model = fit(docs.where(~held), path=path)
    found = identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
