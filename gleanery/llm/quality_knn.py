"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gleanery.llm.common import crc_mod, fresh, lean
from gleanery.llm.words import Words, ranges, words_of

#: Width of the hashed term space, of the latent space; at most as many labelled rows of each class are fitted on; neighbours that vote; documents in a block.
HASHED, LATENT, PER_CLASS, NEIGHBOURS, BLOCK = 1 << 13, 48, 1000, 25, 512
#: Characters that terms count by place in a word.
SHAPE = bytes(c if c in b"\n" else ord("a") if 97 <= c < 123 else ord("A") if 65 <= c < 91 else ord("0") if 48 <= c < 58 else ord("w") if c >= 128 else c for c in range(256))


class Model(NamedTuple):
    idf: np.ndarray  # HASHED
    basis: np.ndarray  # HASHED x latent
    vectors: np.ndarray  # latent x labelled, columns of length 1
    labels: np.ndarray
    prior: float


def _word_terms(words: Words) -> np.ndarray:
    """Hashed terms of each distinct word, a row of three: its lower-cased self, the shapes of its last two characters, and its
    shape with runs cut short (Ab, AB!!, a%%%)."""
    bodies = words.bodies()
    out = np.empty((len(bodies), 3), dtype=np.int64)
    out[:, 0] = hash_array(np.array(pc.ascii_lower(words.unique).to_pylist(), dtype=object), categorize=False) % np.uint64(HASHED)
    shapes = b"\n".join(bodies).translate(SHAPE)
    each: dict[bytes, int] = {}

    def term(mark: bytes, shape: bytes) -> int:
        found = each.get(mark + shape)
        return each.setdefault(mark + shape, zlib.crc32(mark + shape) % HASHED) if found is None else found

    out[:, 1] = [term(b"e", x[-2:]) for x in shapes.split(b"\n")]
    out[:, 2] = [term(b"s", x) for x in re.sub(rb"(.)\1+", rb"\1\1", shapes).split(b"\n")]
    return out


class Terms:
    """Term frequencies of texts, dampened, as one row (ids, values) per text."""

    def rows(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Texts without words have an empty row."""
        words = words_of(texts)
        if not len(words.codes):
            return [_NONE] * len(texts)
        terms, out = _word_terms(words), []
        for a, b, value in zip(words.bounds, words.bounds[1:], texts.cast(pa.binary()), strict=False):
            out.append(self._row(words.codes[a:b], terms, value.as_buffer().to_pybytes()) if b > a else _NONE)
        return out

    def row(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        return self.rows(pa.array([data.decode()]))[0]

    def _row(self, codes: np.ndarray, terms: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        lines = [x for x in data.split(b"\n") if x.strip()]
        repeats, n = len(lines) - len(set(lines)), len(codes)
        twice, distinct = int((codes[1:] == codes[:-1]).sum()), len(np.unique(codes))
        marks = [b"n%d" % (n.bit_length() // 3), b"r%d" % (5 * repeats // max(1, len(lines))), b"d%d" % min(3, 10 * distinct // n), b"a%d" % min(3, 10 * twice // n)]
        counts = np.bincount(terms[codes].ravel(), minlength=HASHED)
        ids = np.flatnonzero(counts)
        values = np.log1p(counts[ids]).astype(np.float32)
        extra = np.array([zlib.crc32(m) % HASHED for m in marks])
        weight = np.float32(max(1.0, float(np.sqrt((values**2).sum())) / 2))
        return np.concatenate([ids, extra]), np.concatenate([values, np.full(len(extra), weight, dtype=np.float32)])


_NONE = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)


def _matrix(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.float32)
    for i, (ids, values) in enumerate(rows):
        np.add.at(out[i], ids, values)
    return out


def _normed(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float, seed: int = 3) -> Model:
    """Latent vectors of labelled term rows: idf-weighted hashed terms, and their leading right singular vectors by randomized
    subspace iteration. Memory: labelled x HASHED floats."""
    a = _matrix(rows, HASHED)
    idf = np.log1p(len(rows) / (1.0 + (a > 0).sum(axis=0))).astype(np.float32)
    a = _normed(a * idf)
    rank = min(LATENT, len(rows))
    start = np.random.default_rng(seed).standard_normal((HASHED, rank + 8)).astype(np.float32)
    q = start
    for _ in range(3):
        q = np.linalg.qr(a.T @ (a @ q))[0]
    _, s, v = np.linalg.svd(a @ q, full_matrices=False)
    basis = (q @ v.T[:, :rank]).astype(np.float32)
    return Model(idf, basis, _normed(a @ basis).T.copy(), labels.astype(np.float32), prior)


def score_block(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Weighted share of label 1 among each document's nearest labelled vectors, by exact cosines of the whole block.

    Weights are the similarities' fourth powers, and classes count by their share among all labelled rows, not among those
    fitted on. Documents without words get the prior share.
    """
    k = min(neighbours, len(model.labels))
    latent = np.empty((len(rows), model.basis.shape[1]), dtype=np.float32)
    for i, (ids, values) in enumerate(rows):
        latent[i] = (values * model.idf[ids]) @ model.basis[ids]
    cosines = _normed(latent) @ model.vectors
    top = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    near = np.maximum(np.take_along_axis(cosines, top, axis=1), 0) ** 4
    share = float(model.labels.mean())
    up, down = (model.prior / share if share else 1.0), ((1 - model.prior) / (1 - share) if share < 1 else 1.0)
    good = model.labels[top]
    ones, zeros = (near * good).sum(axis=1) * up, (near * (1 - good)).sum(axis=1) * down
    score = (ones + 1e-3 * model.prior) / (ones + zeros + 1e-3)
    score[[not len(ids) for ids, _ in rows]] = model.prior
    return np.clip(score, 0, 1).astype(np.float64)


def fit_from(docs: DataFrame, labels: DataFrame, text: str = "text", per_class: int = PER_CLASS, held_out: int = 5) -> Model | None:
    """A model from at most `per_class` labelled rows of each class, those first in a hashed order; None without labels.

    Rows whose crc32(doc_id) is 0 modulo held_out are never used. Null labels, null ids and ids with both labels are not either.
    Of rows with the same labelled id the one whose text comes first is used. The prior counts all usable labels.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_mod("doc_id", held_out) != 0))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    counts = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    if not counts:
        return None
    some = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    picked = F.broadcast(some[0].unionAll(some[1]).withColumnRenamed("doc_id", "of"))  # 2 * per_class rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(picked, F.col("doc_id") == F.col("of")).groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            made = terms.rows(batch.column(2).fill_null(""))
            ids, values = ([m[0].astype("<i4").tobytes() for m in made], [m[1].astype("<f4").tobytes() for m in made])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "quality", "ids", "values"])

    found = sorted(tuple(r) for r in rows.mapInArrow(lean(run), "doc_id long, quality int, ids binary, values binary").collect())
    if not found:
        return None
    made = [(np.frombuffer(r[2], dtype="<i4").astype(np.int64), np.frombuffer(r[3], dtype="<f4")) for r in found]
    return fit(made, np.array([r[1] for r in found]), counts.get(1, 0) / sum(counts.values()))


def scored(docs: DataFrame, model: Model | None, score_name: str, text: str = "text", neighbours: int = NEIGHBOURS) -> DataFrame:
    """All columns of docs and `score_name`. Without a model (no labels) every score is 1."""
    if model is None:
        return docs.withColumn(score_name, F.lit(1.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # HASHED x LATENT floats and 2 * PER_CLASS vectors: under 5 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, own = Terms(), shared.value
        for batch in batches:
            column, scores = batch.column(at).fill_null(""), []
            for low, high in ranges(column):
                rows = terms.rows(column.slice(low, high - low))
                scores += [score_block(own, rows[k : k + BLOCK], neighbours) for k in range(0, len(rows), BLOCK)]
            joined = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(joined, pa.float64())], names=[*batch.schema.names, score_name])

    at = docs.columns.index(text)
    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields, StructField(score_name, DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.3, held_out: int = 5, per_class: int = PER_CLASS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    The text alone makes the score. Null, empty and blank texts get the share of label 1 among the labels; repeated rows get
    equal scores; null doc_ids are scored (their crc is of the empty text) but never learned from; extra columns are ignored;
    long texts are read whole. Without usable labels every score is 1; an empty table gives an empty result.
    """
    model = fit_from(docs, labels, text, per_class, held_out)
    found = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), model, "score")
    return found.select("doc_id", (crc_mod("doc_id", held_out) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without the documents that the classifier rejects."""
    (name,) = fresh(docs, "score")
    return scored(docs, fit_from(docs, labels, text), name, text).where(F.col(name) >= threshold).drop(name)
