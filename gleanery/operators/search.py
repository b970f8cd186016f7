"""Deterministic BM25 over postings, for batches of queries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from gleanery.functions import paths
from gleanery.functions import text as T
from gleanery.operators.best import Best
from gleanery.operators.sizes import if_small

# The ranking constants.
K1, B = 1.2, 0.75
#: So many terms are looked up in a stored index by a pushed filter; more are joined.
FEW_TERMS = 500
#: Queries that are answered in one pass over the documents, and cells and rows of a block's table of scores.
AT_ONCE, CELLS, ROWS = 20_000, 1 << 22, 1024
#: The same words as text.TOKEN's in bytes in lower case, and characters that a snippet is made of.
WORD, HEAD = re.compile(rb"[a-z0-9_]+"), 310
#: Postings in a batch.
PIECE = 1 << 16


def _terms(docs: DataFrame, key: str) -> DataFrame:
    """(key, term, tf, dl): the words of each row of docs, counted where the row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(low, ROWS) for low in range(0, batch.num_rows, ROWS)):
                rows, terms, tf, dl = [], [], [], []
                for i, text in enumerate(part.column(1).cast(pa.binary())):
                    words = WORD.findall((text.as_py() or b"").lower())
                    times = Counter(words)
                    rows += [i] * len(times)
                    terms += times.keys()
                    tf += times.values()
                    dl += [len(words)] * len(times)
                names = pa.array(terms, pa.binary()).cast(pa.string())
                for low in range(0, len(rows), PIECE):  # a key is long beside its terms
                    own = slice(low, low + PIECE)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[own], pa.int64())), names[own], pa.array(tf[own], pa.int64()), pa.array(dl[own], pa.int32())], [key, "term", "tf", "dl"])

    schema = StructType([docs.schema[key], *StructType.fromDDL("term string, tf long, dl int")])
    return docs.select(key, "text").mapInArrow(run, schema)


def postings(docs: DataFrame, key: str = "chunk_id", wanted: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, dl) of documents (key, text), of all terms or those wanted (term).

    No posting is shuffled: a row's words are counted where it is. Only keys that several rows have are found by a shuffle of the
    keys, and these rows' counts are added up.
    """
    each = _terms(docs, key)
    if wanted is not None:
        each = each.join(wanted, "term", "left_semi")
    again = docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(F.col(key).alias("_again"))
    marked = each.join(if_small(again), F.col(key) == F.col("_again"), "left")
    added = marked.where("_again is not null").groupBy(key, "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    return marked.where("_again is null").select(key, "term", "tf", "dl").unionAll(added)


def stats(docs: DataFrame) -> DataFrame:
    """One row: n documents, avgdl. A stored length, dl, saves tokenizing."""
    length = F.col("dl") if "dl" in docs.columns else F.size(T.tokens("text"))
    return docs.select(length.alias("dl")).agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))


def filtered(docs: DataFrame, file_glob: str | None = None, path_prefix: str | None = None) -> DataFrame:
    """Documents under the filters; corpus statistics are to be taken after them."""
    prefix = paths.normal_prefix(path_prefix)
    out = docs.where(F.col("path").startswith(prefix)) if prefix else docs
    return out.where(paths.matches_glob("path", file_glob)) if file_glob else out


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term), each once."""
    return queries.select("query_id", F.explode(F.array_distinct(T.tokens("query"))).alias("term"))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * F.lit(K1 + 1.0) / (tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * dl / avgdl))


def _wanted(words: pa.Array, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, at): where a list of words has a wanted one, its code, and its place among all words."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    codes = np.fromiter((place.get(w, -1) for w in coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary))
    each = codes[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(each >= 0)
    return np.repeat(np.arange(len(words)), sizes)[at], each[at], at


def _counted(texts: pa.Array, place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, tf, dl): how often each wanted word stands in a text, and how many words each text has. Of ASCII letters alone, so that bytes can be searched."""
    row, code, tf, dl = [], [], [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts.cast(pa.binary())):
        words = WORD.findall((text.as_py() or b"").lower())
        dl[i] = len(words)
        times = Counter(map(place.get, words))
        times.pop(None, None)
        row += [i] * len(times)
        code += times.keys()
        tf += times.values()
    return *(np.array(x, dtype=np.int64) for x in (row, code, tf)), dl


def _measured(docs: DataFrame, place: dict[str, int]) -> tuple[dict[str, int], int, int]:
    """(df by term, documents, words) in one pass over docs; a row per term and task is shuffled."""
    names, coded = list(place), {t.encode(): i for t, i in place.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(names), dtype=np.int64), 0, 0
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                _, code, _, dl = _counted(part.column(0), coded)
                df += np.bincount(code, minlength=len(names))
                n, total = n + part.num_rows, total + int(dl.sum())
        found = np.flatnonzero(df)
        terms = pa.array([names[i] for i in found] + [None], pa.string())
        yield pa.RecordBatch.from_arrays([terms, pa.array(np.append(df[found], n)), pa.array(np.append(0 * found, total))], ["term", "n", "total"])

    rows = docs.select("text").mapInArrow(run, "term string, n long, total long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    whole = [r for r in rows if r["term"] is None]
    return {r["term"]: r["n"] for r in rows if r["term"] is not None}, sum(r["n"] for r in whole), sum(r["total"] for r in whole)


def bm25(docs: DataFrame, queries: DataFrame, top_k: int, key: str = "chunk_id", index: DataFrame | None = None, part: bool = False) -> DataFrame:
    """(query_id, key, path, start_line, end_line, snippet, score, matched_terms, rank) for queries (query_id, query).

    Two passes over the documents and no shuffle by term or document: one for the statistics of the queries' terms, a row of
    each per task; and one that scores blocks of documents where they lie, all queries at once, by adding the
    terms' weights term by term into a table of documents and queries. Each task keeps a query's top_k, and only these are
    shuffled. Scores add up in the order of terms, so they don't depend on partitioning. Ties go by path and start line. The
    queries are a stated set; of more than AT_ONCE some half as many are answered in a pass (a `part`). docs: key, path, start_line, end_line, text;
    index: stored postings of these docs, which save both passes the texts.
    """
    spark = docs.sparkSession
    asked = queries.select("query_id", F.array_sort(F.array_distinct(T.tokens("query"))).alias("terms"))
    parts = -(-asked.count() // AT_ONCE)
    if parts > 1 and not part:
        each = [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(2 * parts)) == g) for g in range(2 * parts)]
        return reduce(DataFrame.unionByName, [bm25(docs, q, top_k, key, index, True) for q in each])
    rows = asked.collect()
    terms = sorted({t for r in rows for t in r["terms"]})
    place = {t: i for i, t in enumerate(terms)}
    fields = [docs.schema[c] for c in (key, "path", "start_line", "end_line")]
    schema = StructType([queries.schema["query_id"], *fields, StructField("snippet", StringType()), StructField("score", DoubleType()), StructField("matched_terms", ArrayType(StringType()))])
    if index is None:
        df, n, total = _measured(docs, place) if terms else ({}, 0, 0)
        found = docs.select(key, "path", "start_line", "end_line", "text")
    else:
        hits = index.where(F.col("term").isin(terms)) if len(terms) <= FEW_TERMS else index.join(if_small(spark.createDataFrame([(t,) for t in terms], "term string")), "term", "left_semi")
        df = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}
        n, total = docs.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        by_key = hits.groupBy(key).agg(F.collect_list("term").alias("words"), F.collect_list(F.col("tf").cast("int")).alias("times"))
        found = docs.select(key, "path", "start_line", "end_line", "dl").join(by_key, key).select(key, "path", "start_line", "end_line", "words", "times", "dl")
    if not df:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(0))
    idf_of = {r["term"]: r["idf"] for r in spark.createDataFrame([(t, d) for t, d in df.items()], "term string, df long").select("term", idf(F.lit(n), F.col("df")).alias("idf")).collect()}
    inverse, average = np.array([idf_of.get(t, 0.0) for t in terms]), total / n
    wanted = [np.array([place[t] for t in r["terms"] if t in df], dtype=np.int64) for r in rows]
    of_term: list[list[int]] = [[] for _ in terms]
    for q, own in enumerate(wanted):
        for t in own.tolist():
            of_term[t].append(q)
    shared = spark.sparkContext.broadcast((place, terms, inverse, [np.array(x, dtype=np.int64) for x in of_term], wanted, [r["query_id"] for r in rows]))  # the queries of one pass

    plain = index is None

    def counted(part: pa.RecordBatch, place: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if plain:
            return _counted(part.column(4), place)
        row, code, at = _wanted(part.column(4), {t.decode(): i for t, i in place.items()})
        return row, code, part.column(5).flatten().to_numpy(zero_copy_only=False)[at], part.column(6).to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, terms, inverse, of_term, wanted, ids = shared.value
        place = {t.encode(): i for t, i in place.items()}
        best, types, size = Best(len(ids), top_k), None, min(ROWS, max(16, CELLS // len(ids)))
        for batch in batches:
            types = [batch.schema.field(i).type for i in range(4)]
            for part in (batch.slice(low, size) for low in range(0, batch.num_rows, size)):
                row, code, tf, dl = counted(part, place)
                pairs, back = np.unique(row * len(terms) + code, return_inverse=True)
                tf = np.bincount(back, weights=tf, minlength=len(pairs)) if len(pairs) else np.zeros(0)
                row, code = pairs // len(terms), pairs % len(terms)
                weights = inverse[code] * (tf * (K1 + 1.0) / (tf + K1 * ((1.0 - B) + B * dl[row] / average)))
                paths_, starts = part.column(1).to_pylist(), part.column(2).to_pylist()
                order = sorted(range(part.num_rows), key=lambda i: (paths_[i], starts[i]))
                rank = np.empty(part.num_rows, dtype=np.int64)
                rank[np.array(order, dtype=np.int64)] = np.arange(part.num_rows)
                own_row, by = rank[row], np.argsort(code, kind="stable")
                bounds = np.searchsorted(code[by], np.arange(len(terms) + 1))
                scores = np.zeros((len(ids), part.num_rows))
                for t in np.unique(code).tolist():
                    at = by[bounds[t] : bounds[t + 1]]
                    scores[np.ix_(of_term[t], own_row[at])] += weights[at]
                records: dict[int, tuple] = {}  # what is kept of a document, once for all queries that keep it
                for q, chosen in best.offered(scores, positive=True):
                    for j in chosen.tolist():
                        i = order[j]
                        if i not in records:
                            head = part.column(4)[i].as_py()[:HEAD] if plain else None
                            records[i] = (part.column(0)[i].as_py(), paths_[i], starts[i], part.column(3)[i].as_py(), head, code[slice(*np.searchsorted(row, [i, i + 1]))].astype(np.int32))
                        best.take(q, float(scores[q, j]), (paths_[i], starts[i]), records[i])
                best.cut()
        kept = best.entries()
        while some := list(islice(kept, ROWS)):
            columns = [pa.array([e[i] for *_, e in some], t) for i, t in enumerate([*types, pa.string()])]
            matched = [[terms[t] for t in wanted[q][np.isin(wanted[q], e[5])]] for q, _, e in some]
            yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q, *_ in some]), *columns, pa.array([s for _, s, _ in some], pa.float64()), pa.array(matched, pa.list_(pa.string()))], names)

    names = schema.fieldNames()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "start_line")
    top = found.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    if index is None:
        return top.withColumn("snippet", T.snippet(T.lines("snippet")))
    texts = docs.select(key, T.snippet(T.lines("text")).alias("snippet"))
    return top.drop("snippet").join(texts, key).select(*names, "rank")
