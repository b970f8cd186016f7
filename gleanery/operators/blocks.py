"""Postings in blocks with bounds, and exact BM25 that skips the ranges of documents that cannot be among the best."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from gleanery.functions import text as T
from gleanery.operators.search import FEW_TERMS, K1, WORD, B, idf, weight
from gleanery.operators.sizes import if_small

#: Ranges of the greatest bounds, scored first to learn how good a query's best are.
SEEDS = 2
#: Bounds are sums in another order than scores; so much they may lack.
SLACK = 1e-9
#: Rows of a stated set (a query's terms, a query's threshold), of ranges and of hits that are sent to all.
SENT = 20_000
#: More than a range has documents, a power of two; queries that are scored in a range at once; the least score there is.
PLACES, AT_ONCE, LEAST = 1 << 16, 4096, float(np.nextafter(0.0, 1.0))
HIT = ["chunk_id", "path", "start_line", "end_line", "snippet"]


def build(chunks: DataFrame) -> DataFrame:
    """(term, range, n, max_tf, min_dl, docs) of chunks (doc, range, dl, text): a term's postings (doc, tf, dl) in one range of documents.

    A block holds as many postings as a range has documents at most, so the commonest term is many rows in many partitions.
    Chunks of a range lie together, so a task makes blocks where they are, and nothing is shuffled. A range that two tasks read
    (at the border of a large file's row groups) has two blocks of a term, which a search takes together.
    """
    posting = pa.struct([("doc", pa.int64()), ("tf", pa.int32()), ("dl", pa.int32())])

    def block(number: int, docs: list[int], lengths: list[int], sizes: list[int], terms: list[bytes], times: list[int]) -> pa.RecordBatch:
        coded = pa.array(terms, pa.binary()).dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        bounds = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1)).astype(np.int32)
        of = np.repeat(np.arange(len(docs)), sizes)[order]
        doc, tf, dl = np.array(docs, dtype=np.int64)[of], np.array(times, dtype=np.int32)[order], np.array(lengths, dtype=np.int32)[of]
        columns = [np.full(len(bounds) - 1, number), np.diff(bounds).astype(np.int64), np.maximum.reduceat(tf, bounds[:-1]), np.minimum.reduceat(dl, bounds[:-1])]
        rows = pa.StructArray.from_arrays([pa.array(doc), pa.array(tf), pa.array(dl)], fields=list(posting))
        return pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), *map(pa.array, columns), pa.ListArray.from_arrays(pa.array(bounds), rows)], ["term", "range", "n", "max_tf", "min_dl", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, ([], [], [], [], [])
        for batch in batches:
            for doc, number, dl, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.binary()), strict=True):
                if number != at and parts[3]:
                    yield block(at, *parts)
                if number != at:
                    at, parts = number, ([], [], [], [], [])
                found = Counter(WORD.findall((text.as_py() or b"").lower()))
                for part, values in zip(parts, ([doc], [dl], [len(found)], found.keys(), found.values()), strict=True):
                    part.extend(values)
        if parts[3]:
            yield block(at, *parts)

    return chunks.select("doc", "range", "dl", "text").mapInArrow(run, "term string, range long, n long, max_tf int, min_dl int, docs array<struct<doc:long,tf:int,dl:int>>")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT else df


def _place(doc: Column | str) -> Column:
    """A document's number within its range and as many neighbours as a range has documents at most."""
    return T.col(doc).bitwiseAND(PLACES - 1).cast("int")


def _scorer(rows: list[Row], idf_of: dict[str, float], average: float, top_k: int, least: dict[int, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over the rows of Search.best(), a range's beside each other: its queries, then its blocks by term."""
    code = {t: i for i, t in enumerate(sorted(idf_of))}
    names, inverse = list(code), np.array([idf_of[t] for t in code])
    wanted = [np.array([code[t] for t in r["terms"] if t in code], dtype=np.int64) for r in rows]
    of_term: list[list[int]] = [[] for _ in code]
    for q, own in enumerate(wanted):
        for t in own.tolist():
            of_term[t].append(q)
    of_term = [np.array(x, dtype=np.int64) for x in of_term]

    def scored(floor: np.ndarray, tops: list[list[float]], places: np.ndarray, ok: list[int] | None, base: int, parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, float, list[str]]]:
        docs = np.unique(np.concatenate([p[1] for p in parts]))
        counts = np.ones(len(docs), dtype=bool) if ok is None else np.isin(docs, ok)
        scores, local = np.zeros((len(places), len(docs))), np.full(len(rows), -1)
        local[places] = np.arange(len(places))
        have, row_of = np.zeros((len(parts), len(docs)), dtype=bool), np.full(len(names), -1)
        for i, (t, at, tf, dl) in enumerate(parts):
            at, own = np.searchsorted(docs, at), local[of_term[t]]
            row_of[t] = i if row_of[t] < 0 else row_of[t]
            have[row_of[t], at] = True
            scores[np.ix_(own[own >= 0], at)] += inverse[t] * (tf * (K1 + 1.0) / (tf + K1 * ((1.0 - B) + B * dl / average)))
        scores[:, ~counts] = 0.0
        for q in np.flatnonzero(scores.max(axis=1) >= floor[places]).tolist():
            place = int(places[q])
            some = np.flatnonzero(scores[q] >= floor[place])
            some = some[np.argsort(-scores[q][some], kind="stable")[:top_k]]
            own = row_of[wanted[place]]
            for j in some.tolist():
                yield place, base + int(docs[j]), float(scores[q, j]), [names[t] for t, i in zip(wanted[place], own, strict=True) if i >= 0 and have[i, j]]
            tops[place] = heapq.nlargest(top_k, [*tops[place], *scores[q][some].tolist()])
            if len(tops[place]) == top_k:
                floor[place] = max(floor[place], tops[place][-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, tops = np.array([max(least.get(i, 0.0), LEAST) for i in range(len(rows))]), [[] for _ in rows]
        key = places = ok = base = None
        parts: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            for low in range(0, len(places) if parts else 0, AT_ONCE):
                if found := list(scored(floor, tops, places[low : low + AT_ONCE], ok, base, parts)):
                    place, doc, score, matched = zip(*found, strict=True)
                    columns = [pa.array(place, pa.int32()), pa.array([key[0]] * len(found), pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.float64()), pa.array(matched, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, ["place", "seg", "doc", "score", "matched_terms"])

        for batch in batches:
            seg, number, term, bases, oks, asked = (batch.column(c).to_pylist() if c != "ok" else batch.column(c) for c in ("seg", "range", "term", "base", "ok", "places"))
            lists = [batch.column(c) for c in ("at", "tf", "dl")]
            for i in range(batch.num_rows):
                if (seg[i], number[i]) != key:
                    if key is not None:
                        yield from out()
                    key, places, parts = (seg[i], number[i]), np.zeros(0, dtype=np.int64), []
                if term[i] is None:
                    places = np.array(asked[i], dtype=np.int64)
                elif term[i] in code and len(places):
                    base, ok = bases[i], oks[i].as_py() if not parts else ok
                    parts.append((code[term[i]], *(x[i].values.to_numpy(zero_copy_only=False) for x in lists)))
        if key is not None:
            yield from out()

    return run


class Search:
    """One batch of queries (query_id, query) over blocks and chunks of an index; hits() and report() share what is worked out.

    blocks: build()'s rows of all segments, with `seg`; chunks: all chunks (seg, doc, range, dl and HIT), dead ones too;
    allowed: those that count (alive, under the filters), or None if all do. Statistics are of the allowed ones. A range of
    documents whose bound (the sum over a query's terms of the greatest weight in the range) is below the query's k-th best
    score so far is not read. Bounds hold for any mean length, since a weight grows with tf and falls with length; the k-th best
    so far comes from the SEEDS ranges of greatest bounds. All results are exact, ties included.
    """

    def __init__(self, blocks: DataFrame, chunks: DataFrame, queries: DataFrame, top_k: int, allowed: DataFrame | None = None, seg: str = "_seg"):
        self.top_k, self.queries = top_k, queries
        spark = self.spark = queries.sparkSession
        chunks, blocks = chunks.withColumnRenamed(seg, "seg"), blocks.withColumnRenamed(seg, "seg")
        self.allowed = chunks if allowed is None else allowed.withColumnRenamed(seg, "seg")
        self.rows = queries.select("query_id", F.array_sort(F.array_distinct(T.tokens("query"))).alias("terms")).collect()  # a stated set
        terms = sorted({t for r in self.rows for t in r["terms"]})
        self.n, total = self.allowed.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        asked = blocks.where(F.col("term").isin(terms)) if len(terms) <= FEW_TERMS else blocks.join(_sent(spark.createDataFrame([(t,) for t in terms], "term string"), len(terms)), "term", "left_semi")
        if allowed is None:
            self.blocks, counted = asked.withColumn("ok", F.lit(None).cast("array<int>")), F.col("n")
        else:  # whole ranges count by their blocks' sizes, and only the blocks of ranges in which some documents count are opened
            every = chunks.groupBy("seg", "range").agg(F.count("*").alias("all"))
            some = self.allowed.groupBy("seg", "range").agg(F.collect_list(_place("doc")).alias("ok"))
            ranges = some.join(every, ["seg", "range"]).select("seg", "range", F.when(F.size("ok") < F.col("all"), F.col("ok")).alias("ok"))
            known = ranges.limit(SENT + 1).toArrow()  # bounded
            self.blocks = asked.join(F.broadcast(spark.createDataFrame(known, ranges.schema)) if known.num_rows <= SENT else ranges, ["seg", "range"])
            counted = F.when(F.col("ok").isNull(), F.col("n")).otherwise(F.size(F.array_intersect(F.transform("docs.doc", _place), F.col("ok"))))
        df = self.blocks.groupBy("term").agg(F.sum(counted).alias("df")).where("df > 0")
        self.df = {r["term"]: r["df"] for r in df.collect()} if terms else {}
        self.average = total / self.n if self.n else 0.0
        known = spark.createDataFrame(list(self.df.items()), "term string, df long").select("term", idf(F.lit(self.n), F.col("df")).alias("idf")).collect()
        self.idf = {r["term"]: r["idf"] for r in known}
        pairs = [(i, t, self.idf[t]) for i, r in enumerate(self.rows) for t in r["terms"] if t in self.idf]
        self.terms = _sent(spark.createDataFrame(pairs, "place int, term string, idf double"), len(pairs))
        self._planned: DataFrame | None = None

    def bounds(self) -> DataFrame:
        """(place, seg, range, bound): what a document of the range may score at most for the query at a place. No posting is read."""
        met = self.blocks.select("seg", "range", "term", "max_tf", "min_dl").join(self.terms, "term")
        return met.groupBy("place", "seg", "range").agg(F.sum(F.col("idf") * weight(F.col("max_tf"), F.col("min_dl"), F.lit(self.average))).alias("bound"))

    def best(self, chosen: DataFrame, least: dict[int, float]) -> DataFrame:
        """(place, seg, doc, score, matched_terms): of the ranges in chosen (place, seg, range) at least each query's top_k, with what ties with the last.

        A range's blocks meet in one task, where they are scored for all its queries at once: a posting is shuffled once and not
        for each query, and no score is shuffled that a task knows to be too small (below `least`, or its own k-th best).
        Weights add up in the order of terms. A range's documents are numbered in the order of ties.
        """
        asked = chosen.groupBy("seg", "range").agg(F.collect_list("place").alias("places"))
        nothing = {c: F.lit(None).cast(kind) for c, kind in (("term", "string"), ("base", "long"), ("at", "array<int>"), ("tf", "array<int>"), ("dl", "array<int>"), ("ok", "array<int>"), ("places", "array<int>"))}
        first = F.col("docs")[0]["doc"]
        postings = self.blocks.join(if_small(asked.select("seg", "range"), SENT), ["seg", "range"], "left_semi")
        postings = postings.withColumns(nothing | {"term": F.col("term"), "base": first - _place(first), "at": F.transform("docs.doc", _place), "tf": F.col("docs.tf"), "dl": F.col("docs.dl"), "ok": F.col("ok")})
        met = postings.select("seg", "range", *nothing).unionAll(asked.withColumns(nothing | {"places": F.col("places")}).select("seg", "range", *nothing))
        met = met.repartition("seg", "range").sortWithinPartitions("seg", "range", F.col("term").asc_nulls_first())
        return met.mapInArrow(_scorer(self.rows, self.idf, self.average, self.top_k, least), "place int, seg long, doc long, score double, matched_terms array<string>")

    def planned(self) -> DataFrame:
        """(place, seg, range, bound): the ranges that are to be scored. self.least: the k-th best score of a query's seeds, unless these have fewer."""
        if self._planned is None:
            bounds = self._bounds = self.bounds().persist()  # a number for each query and range, asked for five times
            first = Window.partitionBy("place").orderBy(F.desc("bound"), "seg", "range")
            seeds = bounds.withColumn("at", F.row_number().over(first)).where(F.col("at") <= SEEDS)
            best = Window.partitionBy("place").orderBy(F.desc("score"))
            least = self.best(seeds, {}).select("place", "score").withColumn("at", F.row_number().over(best)).where(F.col("at") == self.top_k)
            rows = least.select("place", F.col("score").alias("least")).collect()  # a number for each query
            self.least = {r["place"]: r["least"] for r in rows}
            known = self.spark.createDataFrame([tuple(r) for r in rows], "place int, least double")
            self._planned = bounds.join(_sent(known, len(rows)), "place", "left").where(F.col("least").isNull() | (F.col("bound") * (1 + SLACK) >= F.col("least"))).drop("least")
        return self._planned

    def hits(self) -> DataFrame:
        """(query_id, HIT, score, matched_terms, rank): the top_k of each query by score, path and start line."""
        chosen = self.planned()
        ties = Window.partitionBy("place").orderBy(F.desc("score"))
        found = self.best(chosen, self.least).withColumn("rank", F.rank().over(ties)).where(F.col("rank") <= self.top_k).drop("rank")
        some = found.limit(SENT + 1).collect()
        self._bounds.unpersist()
        found = F.broadcast(self.spark.createDataFrame(some, found.schema)) if len(some) <= SENT else found
        rows = self._named(found).join(self.allowed.select("seg", "doc", *HIT), ["seg", "doc"])
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start_line")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.top_k).select("query_id", *HIT, "score", "matched_terms", "rank")

    def _named(self, rows: DataFrame) -> DataFrame:
        """rows with their query's id for its place."""
        ids = self.spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(self.rows)], StructType([StructField("place", IntegerType()), self.queries.schema["query_id"]]))
        return rows.join(_sent(ids, len(self.rows)), "place").drop("place")

    def report(self) -> DataFrame:
        """(query_id, blocks, scored_blocks, ranges, scored_ranges): what of the queries' postings is read for the result."""
        met = self.blocks.select("seg", "range", "term").join(self.terms, "term")
        chosen = self.planned().select("place", "seg", "range", F.lit(1).alias("kept"))
        both = self._named(met.join(chosen, ["place", "seg", "range"], "left"))
        return both.groupBy("query_id").agg(F.count("*").alias("blocks"), F.count("kept").alias("scored_blocks"), F.count_distinct("seg", "range").alias("ranges"), F.count_distinct(F.when(F.col("kept") == 1, F.struct("seg", "range"))).alias("scored_ranges"))


def empty_hits(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    fields = [queries.schema["query_id"], *(chunks.schema[c] for c in HIT), StructField("score", DoubleType()), StructField("matched_terms", ArrayType(StringType())), StructField("rank", IntegerType())]
    return queries.sparkSession.createDataFrame([], StructType(fields))
