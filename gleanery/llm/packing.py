"""Packing documents into sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import lean, stash, stored_rows, with_uid
from gleanery.llm.subwords import bodies, default_tokenizer, loaded, lowered
from gleanery.llm.words import ranges, words_of

CAPACITY = 4096
#: A sequence with more padding than this is cut into sequences of powers of two, which need none.
MAX_PADDING = 64
#: Pieces of one length are numbered in parts of about so many, so that no length meets in one task however many pieces it has.
PART = 50_000


class Pattern(NamedTuple):
    """`times` sequences, each with counts[l] pieces of length l."""

    counts: dict[int, int]
    times: int


def fill_window(lengths: list[tuple[int, int]], room: int) -> dict[int, int]:
    """How many of each length (length, count; longest first) add up closest to room from below.

    Subset sums as bits of an integer: bit s is set if some pieces add up to s. Counts are split into powers of two. The bits
    before each item are kept, so that the choice can be traced back; the scan ends once room itself is reached.
    """
    mask, reach, trace = (1 << (room + 1)) - 1, 1, []
    for length, count in lengths:
        count = min(count, room // length)
        some = 1
        while count > 0:
            take = min(some, count)
            trace.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            count, some = count - take, some * 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(trace):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + take
            at -= length * take
    return found


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up the multiset of lengths: the longest one left, and the pieces that fill its window best.

    A pattern is used as often as the counts allow, so each leaves of some length fewer pieces than it takes: about one pattern
    per length, for a large corpus as for a small one.
    """
    left, found = dict(histogram), []
    order = sorted(left, reverse=True)
    while order:
        longest = order[0]
        left[longest] -= 1
        counts = fill_window([(x, left[x]) for x in order if left[x]], capacity - longest)
        left[longest] += 1
        counts[longest] = counts.get(longest, 0) + 1
        times = min(left[x] // n for x, n in counts.items())
        for x, n in counts.items():
            left[x] -= n * times
        order = [x for x in order if left[x]]
        found.append(Pattern(counts, times))
    return found


def segments(fill: int, capacity: int, max_padding: int) -> list[int]:
    """Where the sequences of a filled window begin, and its end: one sequence, or powers of two if it lacks much."""
    if capacity - fill <= max_padding or fill & (fill - 1) == 0:
        return [0, fill]
    bounds = [0]
    for bit in range(fill.bit_length() - 1, -1, -1):
        if fill >> bit & 1:
            bounds.append(bounds[-1] + (1 << bit))
    return bounds


def _places(patterns: list[Pattern], capacity: int, max_padding: int) -> dict[int, list[tuple]]:
    """length -> (first rank, pieces per window, first sequence, offset, segment bounds), by rank. At most a few entries per pattern."""
    places, used, sequence = {}, {}, 0
    for counts, times in patterns:
        bounds, offset = segments(sum(x * n for x, n in counts.items()), capacity, max_padding), 0
        for length in sorted(counts, reverse=True):
            rank = used.get(length, 0)
            places.setdefault(length, []).append((rank, counts[length], sequence, offset, bounds))
            used[length] = rank + counts[length] * times
            offset += counts[length] * length
        sequence += times * (len(bounds) - 1)
    return places


def _crc(ids: bytes) -> int:
    return zlib.crc32(np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes())


def pieces(docs: DataFrame, capacity: int, tokenizer: str, end: int, text: str) -> DataFrame:
    """(uid, doc_id, start, length, ids_crc32, doc_tokens): full windows of each document, then its rest. Streams over documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = loaded(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            uids, doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for a, b in ranges(texts, 1 << 20):
                words = words_of(lowered(texts.slice(a, b - a)))
                ids, ends = subwords.of_words(words)
                bounds, whole = np.concatenate([[0], ends])[words.bounds].tolist(), memoryview(ids.astype("<u4")).cast("B")
                for i, low, high in zip(range(a, b), bounds, bounds[1:], strict=False):
                    n = high - low + 1
                    for at in range(0, n, capacity):
                        crc = zlib.crc32(whole[4 * (low + at) : 4 * min(high, low + at + capacity)])
                        rows.append((uids[i], doc_ids[i], at, min(capacity, n - at), crc if at + capacity < n else zlib.crc32(last, crc), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), schema=schema)

    names, last = ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens"], end.to_bytes(4, "little")
    schema = pa.schema([(x, pa.int64()) for x in names])
    return with_uid(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))).select("uid", "doc_id", "text").mapInArrow(lean(run), ", ".join(f"{x} long" for x in names))


def pack(docs: DataFrame, capacity: int = CAPACITY, max_padding: int = MAX_PADDING, tokenizer: str | None = None, end: int = 2, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its subword ids and the end id (null and empty texts: the end id alone). Documents of `capacity` ids or
    more give full windows and a rest. The numbers of pieces of each length, at most `capacity` counts whatever the corpus,
    go to the driver, which plans windows by minimum bin slack. Pieces are numbered within their length, in hashed parts of
    about PART pieces, and find their window by that number. Windows that would need more than max_padding ids of padding are cut into sequences of
    powers of two; only documents with a piece cut that way are tokenized again. Repeated rows and doc_ids are packed one by
    one, equal pieces in either order; a null doc_id is kept; extra columns are ignored; an empty table gives an empty result.
    """
    docs = stored_rows(docs)
    tokenizer = tokenizer or default_tokenizer()
    cut = stash(pieces(docs, capacity, tokenizer, end, text), "packing-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = _places(minimum_bin_slack(histogram, capacity), capacity, max_padding)
    many = F.array(*(F.lit(1 + histogram.get(x, 0) // PART) for x in range(capacity + 1)))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "uid"), F.get(many, F.col("length").cast("int"))))
    sizes = cut.groupBy("length", "salt").count()
    before = stash(sizes.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before")), "packing-sizes")
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "uid")) - 1).join(before, ["length", "salt"])
    names = ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "whole"]
    schema = pa.schema([(x, pa.int64()) for x in names])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = {x: [e[0] for e in entries] for x, entries in places.items()}
        for batch in batches:
            rows: list[tuple] = []
            for uid, doc_id, start, length, crc, n, rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, per, sequence, offset, bounds = places[length][bisect_right(starts[length], rank) - 1]
                window, slot = divmod(rank - first, per)
                at = offset + slot * length
                sequence += window * (len(bounds) - 1)
                k = bisect_right(bounds, at) - 1
                if at + length <= bounds[k + 1]:
                    rows.append((uid, doc_id, start, length, crc, n, sequence + k, at - bounds[k], 1))
                    continue
                to = at
                while to < at + length:
                    stop = min(bounds[k + 1], at + length)
                    rows.append((uid, doc_id, start + to - at, stop - to, None, n, sequence + k, to - bounds[k], 0))
                    to, k = stop, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), schema=schema)

    placed = ranked.select("uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("before")).alias("rank")).mapInArrow(lean(place), ", ".join(f"{x} long" for x in names))
    placed = stash(placed, "packing-placed")

    def crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = loaded(tokenizer)
        for batch in batches:
            rows = []
            for body, row_cuts in zip(bodies(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                ids = subwords.of_text(body) + end.to_bytes(2, "little")
                rows += [{**c, "ids_crc32": _crc(ids[2 * c["start"] : 2 * (c["start"] + c["length"])])} for c in row_cuts]
            yield pa.RecordBatch.from_pylist(rows, schema)

    again = placed.where("whole = 0").groupBy("uid").agg(F.collect_list(F.struct("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "whole", "uid")).alias("cuts")).withColumnRenamed("uid", "of")  # a document's own cuts
    again = stash(again, "packing-cuts")  # its size is known then: few documents, as a rule, to be broadcast
    texts = with_uid(docs.select(F.col(text).alias("text"))).join(again, F.col("uid") == F.col("of")).select("text", "cuts")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.where("whole = 1").select(*columns).unionAll(texts.mapInArrow(lean(crcs), ", ".join(f"{x} long" for x in names)).select(*columns))
