"""Substring dedup: paragraph MinHash banding with exact verification, and removals clustered by components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Recent, fresh, lean, stash, stored_rows, with_uid
from gleanery.llm.components import connected_components
from gleanery.llm.subwords import bodies
from gleanery.llm.words import ranges

WIDTH, SIMILARITY = 5, 0.8
#: Bands of rows: two paragraphs of similarity 0.8 meet in some band with probability 1 - (1 - 0.8^2)^8 = 0.9997.
BANDS, ROWS = 8, 2
#: Paragraphs have at least LONG words. Blocks run from a cut to the first cut at least LEAST words on; a cut is before a word whose hash is the least within NEAR words.
LONG, LEAST, NEAR = 20, 16, 4
#: Pivots of a large bucket of a band. In buckets of up to SMALL members all pairs are compared, which are no more.
PIVOTS, SMALL = 8, 16
#: Values of the filter that thins out documents before a join: a fixed bound on what is broadcast.
FILTER = 1 << 18
#: Words whose hashes a worker keeps.
CACHED = 160_000
#: Texts are taken together up to so many bytes, since most are too short for arrays of their own; one longer text is taken by itself.
TOGETHER = 1 << 17
_PRIMES = np.random.default_rng(11).integers(1, 1 << 62, size=(2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """A hash for each shingle of a word-hash sequence, in order; a shorter sequence is one shingle."""
    n = max(1, len(words) - width + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(words))):
        h += words[k : k + n]
        h *= np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    return _mixed(h)


def band_hashes(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """BANDS hashes (a row each) of the shingle ranges, from the least values of BANDS * ROWS hash functions."""
    bounds = np.empty(2 * len(starts), dtype=np.int64)
    bounds[::2], bounds[1::2] = starts, ends
    x = np.append(shingles, np.uint64(0))  # so that an end may be the last place
    out = np.zeros((len(starts), BANDS), dtype=np.uint64)
    for k in range(BANDS * ROWS):
        y = x * _PRIMES[0, k]
        y += _PRIMES[1, k]
        y ^= y >> np.uint64(29)
        y[-1] = np.iinfo(np.uint64).max
        least = np.minimum.reduceat(y, bounds)[::2]
        out[:, k // ROWS] = _mixed(out[:, k // ROWS] + least * _PRIMES[0, k] + np.uint64(k))
    return out


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


def cuts(h: np.ndarray, near: int = NEAR, bounds: np.ndarray | None = None) -> np.ndarray:
    """Word places at which blocks begin or end: local minima of the word hashes (the first of equal ones), and both ends of each
    text. bounds: where the texts begin, and the end, if h is of several.

    A cut depends on the `near` words either side only, so a passage is cut alike wherever it stands, but for its rims.
    """
    bounds = np.array([0, len(h)]) if bounds is None else bounds
    at = np.arange(len(h)) + near * np.repeat(np.arange(1, len(bounds)), np.diff(bounds))  # gaps keep texts apart
    wide = np.full(len(h) + near * len(bounds), np.iinfo(np.uint64).max, dtype=np.uint64)
    wide[at] = h
    n = len(wide) - 2 * near
    before, after = wide[:n].copy(), wide[near + 1 : near + 1 + n].copy()
    for k in range(1, near):
        np.minimum(before, wide[k : k + n], out=before)
        np.minimum(after, wide[near + 1 + k : near + 1 + k + n], out=after)
    found = ((before > wide[near : near + n]) & (after >= wide[near : near + n]))[at - near]
    found = np.append(found, False)
    found[bounds] = True
    return np.flatnonzero(found)


def paragraph_bounds(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last): the words of each paragraph of LONG words or more, from the words at which lines begin, and the end.

    A line of so many words is a paragraph; shorter lines that follow each other, as of wrapped text, make up one together. Lines
    without words end it.
    """
    sizes = np.diff(lines)
    full = np.flatnonzero(sizes)
    if not len(full):
        return full, full
    long = sizes[full] >= LONG
    new = np.ones(len(full), dtype=bool)
    new[1:] = long[1:] | long[:-1] | (np.diff(full) > 1)
    first = lines[full[new]]
    last = np.append(first[1:], lines[-1])
    kept = last - first >= LONG
    return first[kept], last[kept]


class Units:
    """Paragraphs and blocks of texts as arrays. Word hashes and powers are kept in a worker."""

    def __init__(self):
        self.cache = Recent(CACHED)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        """Powers of _BASE and of its inverse modulo 2^64, up to n of each."""
        if len(self.powers) < n:
            steps = [np.full(2 * n, np.uint64(x)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
            for step in steps:
                step[0] = 1
            self.powers, self.inverses = map(np.multiply.accumulate, steps)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, start, end, key, bands): the number of the text, places in its code points, a hash of the words in order, and the bands of the first rows, which are the paragraphs."""
        data = b"\n\n".join(texts)  # a line without words ends a paragraph
        raw = np.frombuffer(data, dtype=np.uint8)
        inside = np.concatenate([[False], ~_BLANK[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        n = len(starts)
        h = word_hashes(data.split(), self.cache)
        self._grow(n)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * self.powers[:n], dtype=np.uint64)])
        first, last = paragraph_bounds(np.concatenate([[0], np.searchsorted(starts, np.flatnonzero(raw == 10)), [n]]))
        begin = np.cumsum([0, *(len(t) + 2 for t in texts)])  # in bytes
        bounds = np.searchsorted(starts, begin)  # in words
        at = cuts(h, bounds=bounds)
        text_end = bounds[np.searchsorted(bounds, at, side="right").clip(max=len(texts))]
        at, cut = at[at + LEAST <= text_end], at
        a = np.concatenate([first, at])
        b = np.concatenate([last, cut[np.searchsorted(cut, at + LEAST)]])
        key = _mixed((total[b] - total[a]) * self.inverses[a] + (b - a).astype(np.uint64))
        point = np.cumsum((raw & 0xC0) != 0x80)  # code points up to and with each byte
        bands = band_hashes(shingle_hashes(h), first, last - WIDTH + 1).view(np.int64) if len(first) else np.zeros((0, BANDS), dtype=np.int64)
        text = np.searchsorted(bounds, a, side="right") - 1
        before = np.append(0, point)[begin[text]]
        return text, point[starts[a]] - 1 - before, point[ends[b - 1] - 1] - before, key.view(np.int64), bands


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(uid, start, end, key, bands): paragraphs and blocks by code points, with a 64-bit content key; paragraphs have bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in batches:
            for low, high in ranges(batch.column(1), TOGETHER):
                of, start, end, key, bands = units.of(bodies(batch.column(1).slice(low, high - low)))
                long = np.arange(len(key)) < len(bands)
                offsets = pa.array(np.minimum(np.arange(len(key) + 1), len(bands)) * BANDS, pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(bands.ravel(), pa.int64()), mask=pa.array(~long))
                uid = batch.column(0).take(pa.array(low + of, pa.int64()))
                yield pa.RecordBatch.from_arrays([uid, pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(key), lists], ["uid", "start", "end", "key", "bands"])

    return with_uid(docs.select(text)).select("uid", text).mapInArrow(lean(run), "uid long, start int, end int, key long, bands array<long>")


def word_hashes(words: list[bytes], cache: Recent) -> np.ndarray:
    try:
        joined = b"".join(map(cache.young.__getitem__, words))
    except KeyError:
        new = cache.missing(set(words))
        cache.young.update({w: xxhash.xxh3_64_digest(w) for w in new})
        joined = b"".join(map(cache.young.__getitem__, words))
    return np.frombuffer(joined, dtype="<u8")


def candidate_pairs(signed: DataFrame, name: str = "repeats") -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b: distinct units (key, bands) that meet in a band; and the keys of buckets with more than SMALL members.

    All pairs of small buckets, and in larger ones each member with PIVOTS others at most: those with the least band-salted
    hash in each of PIVOTS slots, found by a bounded aggregate. So a bucket of many near copies yields PIVOTS pairs a member
    instead of all pairs; what these leave apart is for separate_pairs. Entries are shuffled once, by bucket.
    """
    banded = F.transform("bands", lambda h, i: F.xxhash64(h, i))
    entries = signed.select("key", F.explode(banded).alias("bucket")).repartition("bucket")
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = entries.join(sizes, "bucket")
    small = met.where(F.col("n") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    later = lambda x: F.transform(F.filter("keys", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = small.select(F.explode(F.flatten(F.transform("keys", later))).alias("p")).select("p.a", "p.b")
    large = met.where(F.col("n") > SMALL)
    salted = F.struct(F.xxhash64("key", "bucket").alias("h"), F.col("key"))
    pivots = large.groupBy("bucket", F.pmod(F.xxhash64("bucket", "key", F.lit(1)), F.lit(PIVOTS)).alias("slot")).agg(F.min(salted).alias("p")).select("bucket", F.col("p.key").alias("pivot"))
    some = large.join(pivots, "bucket").where("key <> pivot").select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b"))
    return stash(pairs.unionAll(some).distinct(), f"{name}-pairs"), stash(large.select("key").distinct(), f"{name}-large")


def separate_pairs(sets: DataFrame, roots: DataFrame, similarity: float, name: str = "repeats") -> DataFrame:
    """(a, b): all pairs of units of `sets` (key, shingles) under different roots (key, root) that may reach `similarity`.

    An exact prefix filter: with shingles in one order, rare ones first, two sets of similarity s share one of the first
    (1 - s) n + 1 of each. After the first they share, each must have enough left for the overlap that s asks. Shingles that
    only occur under one root yield nothing, so a large group of near copies costs no pairs.
    """
    tokens = sets.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(often, "token").groupBy("key").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    # shingles of one unit alone come first and are in no pair
    first = F.floor((1 - similarity) * F.col("n") + 1e-6) + 1 - (F.col("n") - F.size("own"))
    cut = ranked.where(first > 0).select("key", "root", "n", F.posexplode(F.slice("own", F.lit(1), first.cast("int"))).alias("at", "own"), (F.col("n") - F.size("own")).alias("alone"))
    prefix = stash(cut.select("key", "root", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), F.col("own.token").alias("token")), f"{name}-prefix")
    mixed = prefix.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    kept = prefix.join(mixed, "token")
    one, two = (kept.select("token", *(F.col(c).alias(f"{c}_{side}") for c in ("key", "root", "n", "left"))) for side in "ab")
    needed = similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-6
    met = one.join(two, "token").where((F.col("key_a") < F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & (F.least("left_a", "left_b") >= needed))
    return met.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()


def _shingle_sets(docs: DataFrame, places: DataFrame, text: str) -> DataFrame:
    """(key, shingles): the distinct shingle hashes of units at one place each (uid, start, end, key).

    Documents are thinned by a broadcast filter of FILTER values at most before they are joined with their places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Recent(CACHED)
        for batch in batches:
            keys, shingles = [], []
            for value, spans in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                body = value.as_py()
                for span in spans:
                    keys.append(span["key"])
                    shingles.append(np.unique(shingle_hashes(word_hashes(body[span["start"] : span["end"]].encode().split(), cache))).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(shingles, pa.list_(pa.int64()))], ["key", "shingles"])

    spans = places.groupBy(F.col("uid").alias("of")).agg(F.collect_list(F.struct("start", "end", "key")).alias("spans"))  # of one document
    mark = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    marks = F.broadcast(places.select(mark("uid").alias("mark")).distinct())
    numbered = with_uid(docs.select(F.col(text).alias("text")))
    thinned = numbered.withColumn("mark", mark("uid")).join(marks, "mark", "left_semi")
    joined = thinned.join(spans.hint("shuffle_hash"), F.col("uid") == F.col("of")).select("text", "spans")
    return joined.mapInArrow(lean(run), "key long, shingles array<long>")


def similar_pairs(docs: DataFrame, signed: DataFrame, text: str, similarity: float, name: str = "repeats") -> DataFrame:
    """Pairs (a, b) whose exact Jaccard similarity of shingle sets reaches `similarity`, so that all such pairs of units that
    meet in a band are connected. signed: key, bands, at (uid, start, end)."""
    pairs, large = candidate_pairs(signed, name)
    keys = pairs.select(F.col("a").alias("key")).unionAll(pairs.select("b")).distinct()
    places = stash(signed.join(keys, "key").select("at.uid", "at.start", "at.end", "key"), f"{name}-places")
    sets = stash(_shingle_sets(docs, places, text), f"{name}-sets")

    def similar(pairs: DataFrame) -> DataFrame:
        one = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a")
        both = one.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")

    found = similar(pairs)
    if large.isEmpty():
        return found
    roots = stash(connected_components(found, "a", "b", f"{name}-first"), f"{name}-found").withColumnRenamed("node", "key")
    rest = separate_pairs(sets.join(large, "key", "left_semi"), roots, similarity, name)
    return roots.select(F.col("key").alias("a"), F.col("root").alias("b")).unionAll(similar(rest))


def repeats(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per repeated paragraph or block: doc_id, start, end, class_id, copies, first_doc_id, removed (uid too).

    Paragraphs are lines of LONG words or more, and successive shorter lines if they have as many together. Content-defined blocks of the whole text, which overlap, are taken as well, so
    that a passage is found inside other text: one of over 50 words nearly always holds a whole block. Units of equal words
    are one class. Distinct paragraphs are signed by MinHash of five-word shingles, banded, verified by exact Jaccard
    similarity, and clustered by connected components; blocks are too short for near copies. In a class the first unit by
    (doc_id, null last; row; start) stays and the others are marked `removed`; class_id is the smallest key of the class, start
    and end are code points. Documents without repeats have no row. Null, empty and short texts have no units; repeated rows
    repeat their paragraphs; extra columns are ignored; an empty table gives no rows.
    """
    docs = stored_rows(docs)
    units = stash(paragraphs(docs, text), "repeats-units")
    signed = stash(units.where("bands is not null").groupBy("key").agg(F.first("bands").alias("bands"), F.min(F.struct("uid", "start", "end")).alias("at")), "repeats-signed")
    roots = stash(connected_components(similar_pairs(docs, signed, text, similarity), "a", "b", "repeats-stars"), "repeats-roots")
    again = units.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = stash(again.unionAll(roots.select(F.col("node").alias("key"))).distinct().join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("class_id")), "repeats-classes")
    ids = with_uid(docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    found = stash(units.select("uid", "start", "end", "key").join(wanted, "key").join(ids, "uid").drop("key"), "repeats-found")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "uid", "start", "end")
    classes = found.groupBy("class_id").agg(F.count("*").alias("copies"), F.min(place).alias("first"))
    first_id = F.when(F.col("first.id") != (1 << 63) - 1, F.col("first.id"))
    return found.join(classes, "class_id").select("uid", "doc_id", "start", "end", "class_id", "copies", first_id.alias("first_doc_id"), (place != F.col("first")).alias("removed"))


def without_repeats(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with the removed units cut out of `text` (overlapping ones together)."""
    docs = stored_rows(docs)
    uid, of, at = fresh(docs, "uid", "of", "cuts")
    cuts = repeats(docs, text, similarity).where("removed").groupBy(F.col("uid").alias(of)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(at))

    def keep(acc, c):  # text so far and where it ends in the old one
        part = F.substring(acc["t"], acc["at"] + 1, F.greatest(c["start"] - acc["at"], F.lit(0)))
        return F.struct(acc["t"].alias("t"), F.concat(acc["out"], part).alias("out"), F.greatest(acc["at"], c["end"]).alias("at"))

    start = F.struct(F.col(text).alias("t"), F.lit("").alias("out"), F.lit(0).alias("at"))
    rest = F.aggregate(at, start, keep, lambda acc: F.concat(acc["out"], F.substring(acc["t"], acc["at"] + 1, F.length(acc["t"]))))
    joined = with_uid(docs, uid).join(cuts, F.col(uid) == F.col(of), "left")
    return joined.withColumn(text, F.when(F.col(at).isNull(), F.col(text)).otherwise(rest)).drop(uid, of, at)
