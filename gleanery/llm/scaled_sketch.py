"""Document fingerprints: threshold-scaled sketches of shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Recent, lean

WIDTH = 5
#: Hashes below 2^64 / SCALE are kept.
SCALE = 8
#: Texts of up to so many shingles keep all their hashes, so that short texts are not known by a few of them.
WHOLE = 128
#: Words whose hashes a worker keeps.
CACHED = 160_000
#: Documents are dealt to ranges of about ROWS ids, in MOST ranges at most; a range is sorted on disk and streamed.
ROWS, MOST = 2_000, 20_000


class Sketch(NamedTuple):
    """Sorted shingle hashes: all of a short text (whole), else those below the threshold, which is the same for all. The union of the hashes below it merges two sketches."""

    hashes: np.ndarray
    whole: bool

    def text(self) -> str:
        if self.whole:
            return "=" + self.hashes.astype(">u8").tobytes().hex() if len(self.hashes) else ""
        return "/" + self.hashes.astype(">u8").tobytes().hex()

    def below(self, limit: np.uint64) -> np.ndarray:
        return self.hashes[: np.searchsorted(self.hashes, limit, side="right")] if self.whole else self.hashes


class Sketcher:
    def __init__(self, scale: int = SCALE, width: int = WIDTH):
        self.below, self.width = _below(scale), width
        self.cache = Recent(CACHED)
        odd = [(0x9E3779B97F4A7C15 * (2 * k + 1) ^ (0xD6E8FEB86659FD93 >> k)) | 1 for k in range(width)]
        self.factors = np.array([x & ((1 << 64) - 1) for x in odd], dtype=np.uint64)

    def _word_hashes(self, words: list[bytes]) -> np.ndarray:
        cache = self.cache
        try:
            joined = b"".join(map(cache.young.__getitem__, words))
        except KeyError:
            new = cache.missing(set(words))
            cache.young.update({w: xxhash.xxh3_64_digest(w, 1) for w in new})
            joined = b"".join(map(cache.young.__getitem__, words))
        return np.frombuffer(joined, dtype="<u8")

    def sketch(self, data: bytes) -> Sketch:
        """A shingle's hash mixes its words' hashes by place. Texts of fewer words than a shingle are one shingle."""
        w = self._word_hashes(data.split())
        if not len(w):
            return Sketch(w, True)
        n = max(1, len(w) - self.width + 1)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(min(self.width, len(w))):
            h += w[k : k + n] * self.factors[k]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
        return Sketch(np.unique(h), True) if n <= WHOLE else Sketch(np.unique(h[h <= self.below]), False)


def _below(scale: int) -> np.uint64:
    return np.uint64((1 << 64) // scale - 1)


def likeness(a: Sketch, b: Sketch, scale: int = SCALE) -> float:
    """Jaccard similarity of the shingle sets: exact between short texts, else estimated from the hashes below the threshold, 0 if neither has one there."""
    if a.whole and b.whole:
        x, y = a.hashes, b.hashes
        if not len(x) and not len(y):
            return 1.0
    else:
        x, y = a.below(_below(scale)), b.below(_below(scale))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def containment(a: Sketch, b: Sketch, scale: int = SCALE) -> float | None:
    """Share of a's shingles that b has, however much longer b is: exact between short texts, else estimated. None if no hash of a tells."""
    x, y = (a.hashes, b.hashes) if a.whole and b.whole else (a.below(_below(scale)), b.below(_below(scale)))
    if not len(x):
        return 1.0 if a.whole and not len(a.hashes) else None
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x)


def in_id_order(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, follows, doc_id, text), sorted within partitions by bucket, then follows, doc_id (null last), text.

    Buckets are ranges of ids between quantiles, so that each holds about as many. Every bucket also gets the first document
    of the next one (of the first, after the last) with follows = 1: each document's successor comes after it. Texts move
    once. The ids' quantiles and first ids go to the driver, at most MOST of each.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    rows = ids.count()
    parts = max(1, min(MOST, rows // ROWS))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 10 * parts))).first()[0] if parts > 1 else None
    splits = np.array(sorted(set(cuts or [])), dtype=np.int64)

    @F.pandas_udf("int")
    def bucket_of(found: pd.Series) -> pd.Series:
        at = np.searchsorted(splits, found.fillna(0).astype("int64"), side="right")
        return pd.Series(np.where(found.isna(), len(splits) + 1, at))

    heads = {r["bucket"]: r["head"] for r in ids.withColumn("bucket", bucket_of("doc_id")).groupBy("bucket").agg(F.min("doc_id").alias("head")).collect()}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    first = spark.createDataFrame([(b, heads[b], before[b]) for b in order], "of int, head long, before int")  # at most MOST rows
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("bucket", bucket_of("doc_id")).join(F.broadcast(first), F.col("bucket") == F.col("of"))
    own, also = F.struct(F.col("bucket"), F.lit(0).alias("follows")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("follows"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, also)).otherwise(F.array(own))
    placed = dealt.select("doc_id", "text", F.explode(places).alias("at")).select("at.bucket", "at.follows", "doc_id", "text")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "follows", F.col("doc_id").asc_nulls_last(), "text")


def fingerprints(docs: DataFrame, text: str = "text", scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, contained_edited.

    The edited text is the document with its last quarter (rounded down) replaced by as much of the next document's start.
    Next is by ascending doc_id, null last; repeated doc_ids follow each other by text, and repeated rows follow each other;
    after the last comes the first (of a single document: itself). Null and empty texts have the fingerprint "", alike to each
    other (1.0) and to no other text. Texts of up to WHOLE shingles keep all hashes ("="), longer ones those below the
    threshold ("/"); between a short and a long text only hashes below it count. Texts are streamed in order, two at a time; very long ones are hashed whole; extra columns are ignored; an empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(scale, width)
        at, last, mine = None, None, None
        for batch in batches:
            rows = []
            for bucket, follows, doc_id, value in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3).cast(pa.binary()), strict=True):
                if (at, None) == (bucket, last) and follows:
                    continue  # another row with the first id of the next bucket
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                sketch = maker.sketch(data)
                if at == bucket:
                    body = last[1].decode()
                    cut = len(body) // 4
                    edited = (body[: len(body) - cut] + data.decode()[:cut]).encode()
                    other = maker.sketch(edited)
                    rows.append((last[0], len(body), sha256(edited).hexdigest(), mine.text(), other.text(), likeness(mine, other, scale), likeness(mine, sketch, scale), containment(mine, other, scale)))
                at, last, mine = bucket, None if follows else (doc_id, data), sketch
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((x, pa.string()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")), *((x, pa.float64()) for x in ("near_edited", "near_next", "contained_edited"))])
    return in_id_order(docs, text).mapInArrow(lean(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_edited double")
