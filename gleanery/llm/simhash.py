"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import Recent, fresh, kept, lean, stash, stored_rows, to_all, with_uid
from gleanery.llm.components import connected_components
from gleanery.llm.substring_dedup import BANDS, CACHED, band_hashes, shingle_hashes, similar_pairs, word_hashes

RADIUS = 2
#: Buckets with up to this many fingerprints are compared inside; from larger ones, every fingerprint goes to the exact step.
SMALL = 16
#: Words signed at once by similar_documents.
AT_ONCE = 1 << 17


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """2^(radius+1)-1 bit masks (signed 64-bit) such that any `radius` bit positions are all left out by some mask.

    Each bit i gets a non-zero vector m(i) of radius+1 bits; mask v keeps bit i if <m(i), v> is odd. The vectors of `radius`
    differing bits span less than the whole space, so some non-zero v is orthogonal to all of them: both fingerprints are then
    equal under mask v. With two bits of difference there are 7 masks of about 37 bits.
    """
    top = 2 ** (radius + 1)
    found = [sum(1 << i for i in range(bits) if bin(v & (i % (top - 1) + 1)).count("1") % 2) for v in range(1, top)]
    return [x - (1 << 64) if x >> 63 else x for x in found]


def _fingerprint(data: bytes, width: int) -> int:
    words = data.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), 1 << 15):
        digests = b"".join([xxhash.xxh64_digest(x, 42) for x in shingles[at : at + (1 << 15)]])
        ones += np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """(uid, doc_id, fingerprint long). A bit is 1 if it is set in over half of the XXH64 values (seed 42) of the document's
    shingles of `width` lower-cased words, repeats counted; null and wordless texts have fingerprint 0. Texts are hashed in
    blocks of shingles, so a very long text needs a bounded matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([_fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", width) for x in batch.column(2).cast(pa.binary())], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], ["uid", "doc_id", "fingerprint"])

    return with_uid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))).select("uid", "doc_id", "text").mapInArrow(lean(run), "uid long, doc_id long, fingerprint long")


def _candidates(prints: DataFrame) -> DataFrame:
    """Those of the distinct fingerprints that may have another one within the radius: all that do, and few others."""
    tables = F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks()))
    entries = prints.select("fp", F.posexplode(tables).alias("table", "key"))
    sizes = entries.groupBy("table", "key").count().where("count > 1")
    full = entries.join(sizes, ["table", "key"])
    small = full.where(F.col("count") <= SMALL).groupBy("table", "key").agg(F.collect_list("fp").alias("fps"))
    near = F.filter("fps", lambda x: F.exists("fps", lambda y: (x != y) & (F.bit_count(x.bitwiseXOR(y)) <= RADIUS)))
    return small.select(F.explode(near).alias("fp")).unionAll(full.where(F.col("count") > SMALL).select("fp")).distinct()


def links(prints: DataFrame) -> DataFrame:
    """Edges (fp, to) that connect all distinct fingerprints `fp` within two bits, and no others.

    Every pair within the radius meets in a table of the covering family. Small buckets are compared inside, which drops
    chance meetings; no pairs leave a bucket. Each candidate then names the 65 points that differ from it in one bit or none:
    two fingerprints share such a point exactly if they differ in at most two bits. A point has at most 65 neighbours, so
    each group is bounded, and its members hang under the smallest of them. Work is linear in the candidates, however many
    near copies one text has.
    """
    ball = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(64)))
    stars = _candidates(prints).select("fp", F.explode(ball).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("fps"), F.min("fp").alias("to")).where(F.size("fps") > 1)
    return stars.select(F.explode("fps").alias("fp"), "to").where("fp <> to").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """One row per document: uid, doc_id, fingerprint (long), root (one fingerprint of the component), component_id (smallest
    doc_id that links reach, itself included).

    Fingerprints with 2 or fewer differing bits are linked; texts without words (null, empty, blanks) have fingerprint 0 and
    link like others. Rows with a null doc_id are linked but never name a component unless it has no other id (then null).
    Repeated rows and doc_ids each keep their row; extra columns are ignored; an empty table gives an empty result.
    """
    docs = stored_rows(docs)
    table = stash(fingerprints(docs, text, width), "simhash-prints")
    prints = stash(table.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = connected_components(links(prints), "fp", "to", "simhash-stars")
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("fingerprint"), "root", "component_id")
    return table.join(named, "fingerprint").select("uid", "doc_id", "fingerprint", "root", "component_id")


def shingle_print(shingles: np.ndarray) -> int:
    """The fingerprint of shingle hashes, repeats counted: a bit is 1 if it is set in over half of them. Bounded blocks."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), 1 << 15):
        ones += np.unpackbits(shingles[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big", signed=True)


def _signed(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, key, print, bands) of docs (doc_id, text): a hash of the words in order, the fingerprint of five-word shingles, and their MinHash bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Recent(CACHED)
        for batch in batches:
            texts, low = batch.column(2).cast(pa.binary()), 0
            while low < len(texts):
                keys, prints, shingles, n, high = [], [], [], 0, low
                while high < len(texts) and n < AT_ONCE:
                    words = texts[high].as_buffer().to_pybytes().split() if texts[high].is_valid else []
                    keys.append(xxhash.xxh3_64_intdigest(b" ".join(words), 7))
                    shingles.append(shingle_hashes(word_hashes(words, cache)))
                    prints.append(shingle_print(shingles[-1]) if words else 0)
                    n, high = n + len(words), high + 1
                ends = np.cumsum([len(x) for x in shingles])
                bands = band_hashes(np.concatenate(shingles), ends - [len(x) for x in shingles], ends).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(bands.ravel(), pa.int64()))
                columns = [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(prints, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "key", "print", "bands"])
                low = high

    return with_uid(docs).select("uid", "doc_id", "text").mapInArrow(lean(run), "uid long, doc_id long, key long, print long, bands array<long>")


def similar_documents(docs: DataFrame, text: str = "text", similarity: float = 0.8) -> DataFrame:
    """(uid, doc_id, root): rows have the same root if links connect them.

    Documents are linked if the fingerprints of their five lower-cased words' shingles differ in RADIUS bits at most, found by the
    covering tables, or if the Jaccard similarity of the shingle sets is `similarity` or more, checked exactly. Fingerprints
    alone cannot find the latter: at similarity 0.8 they differ in some 10 of 64 bits, and covering masks for 10 bits are
    2047 tables; so candidates also meet in MinHash bands. Equal texts are linked; texts without words are equal.
    """
    docs = stored_rows(docs)
    lowered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text).alias("text"))
    table = stash(_signed(lowered), "simhash-signed")
    place = F.struct("uid", F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("end"))
    signed = stash(table.groupBy("key").agg(F.first("bands").alias("bands"), F.first("print").alias("print"), F.min(place).alias("at")), "simhash-keys")
    least = stash(signed.groupBy(F.col("print").alias("fp")).agg(F.min("key").alias("least")), "simhash-prints")
    same = signed.join(least, signed.print == least.fp).select(F.col("key").alias("a"), F.col("least").alias("b"))
    near = links(least.select("fp")).join(least, "fp").select("to", F.col("least").alias("a")).join(least.select(F.col("fp").alias("to"), F.col("least").alias("b")), "to").select("a", "b")
    pairs = similar_pairs(lowered, signed.drop("print"), "text", similarity, "simhash").unionAll(same).unionAll(near)
    roots = connected_components(pairs, "a", "b", "simhash-stars")
    return table.select("uid", "doc_id", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").select("uid", "doc_id", F.coalesce("root", "key").alias("root"))


def one_of_each_group(docs: DataFrame, text: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs without all but one row of each group of similar_documents: the row with the smallest doc_id stays (nulls last), then the first row.

    The texts themselves are not shuffled unless the list of dropped rows is too large to broadcast. Columns of any name are
    kept; an empty table gives an empty result.
    """
    docs = stored_rows(docs)
    groups = stash(similar_documents(docs, text, similarity), "simhash-groups")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))
    first = groups.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.uid").alias("kept"))
    uid, gone = fresh(docs, "uid", "gone")
    lost = kept(groups.join(first, groups.uid == first.kept, "left_anti").select(F.col("uid").alias(gone)), "simhash-lost")
    return with_uid(docs, uid).join(to_all(*lost), F.col(uid) == F.col(gone), "left_anti").drop(uid)
