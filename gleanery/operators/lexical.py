"""Lexical structure of sources: identifiers, brace depth, blocks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.functions import text as T

IDENTIFIER = re.compile(T.IDENTIFIER)
#: Identifiers in a batch, or as many as a line has.
PIECE = 1 << 16


def _lines(corpus: DataFrame, kept: Callable[[Column], Column], lines: Callable[[str | Column], Column] = T.lines, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Texts are masked once: the generator takes an expression of `both`, since Spark would filter by a bare column's size, and compute it for that."""
    split = F.struct(lines(T.masked("text")).alias("masked"), lines("text").alias("original"))
    both = T.once(split, lambda x: F.when(F.size(x["masked"]) == F.size(x["original"]), F.arrays_zip(x["masked"].alias("masked"), x["original"].alias("original"))))
    numbered = F.transform("both", lambda x, i: F.struct((i + 1).alias("line"), x["masked"].alias("masked"), x["original"].alias("original")))
    return corpus.select(*keys, both.alias("both")).select(*keys, F.inline(kept(numbered)))


def source_lines(corpus: DataFrame) -> DataFrame:
    """(path, line, masked, original). Files whose masked and original lines don't pair up are left out."""
    return _lines(corpus, lambda rows: rows)


def code_lines(corpus: DataFrame, lines: Callable[[str | Column], Column] = T.lines, keys: Sequence[str] = ("path",)) -> DataFrame:
    """source_lines() with an identifier outside comments and strings: others don't become rows."""
    return _lines(corpus, lambda rows: F.filter(rows, lambda x: x["masked"].rlike("[A-Za-z_$]")), lines, keys)


def identifier_tokens(corpus: DataFrame) -> DataFrame:
    """(path, line, token, n): identifiers outside comments and strings, with how often each stands in its line."""
    found = code_lines(corpus).select("path", "line", F.explode(T.identifiers("masked")).alias("token"))
    return found.groupBy("path", "line", "token").agg(F.count("*").alias("n"))


def identifier_places(corpus: DataFrame, lines: Callable[[str | Column], Column] = T.lines, keys: Sequence[str] = ("path", "line")) -> DataFrame:
    """(keys, token, start_col, end_col): every identifier outside comments and strings, with its first and last column, from 1.

    keys: columns of corpus, and line. Columns are sums of lengths, taken for many lines at once, so that a long line costs no
    more than many short ones; some PIECE identifiers are held at a time.
    """

    def placed(columns: list[pa.Array], row: list[int], counts: list[int], gaps: list[str], tokens: list[str]) -> pa.RecordBatch:
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(np.fromiter(map(len, gaps), np.int64, len(gaps)) + length)
        before = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
        ends -= np.repeat(before, counts)
        of = pa.array(np.repeat(row, counts))
        return pa.RecordBatch.from_arrays([*(c.take(of) for c in columns), pa.array(tokens, pa.string()), pa.array((ends - length + 1).astype(np.int32)), pa.array(ends.astype(np.int32))], [*keys, "token", "start_col", "end_col"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, parts = batch.columns[:-1], ([], [], [], [])
            for i, line in enumerate(batch.columns[-1]):
                text = line.as_py()
                tokens, gaps = IDENTIFIER.findall(text), IDENTIFIER.split(text)[:-1]
                for part, values in zip(parts, ([i], [len(tokens)], gaps, tokens), strict=True):
                    part.extend(values)
                if len(parts[-1]) >= PIECE:
                    yield placed(columns, *parts)
                    parts = ([], [], [], [])
            if parts[-1]:
                yield placed(columns, *parts)

    rows = code_lines(corpus, lines, [k for k in keys if k != "line"]).select(*keys, "masked")
    return rows.mapInArrow(run, StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL("token string, start_col int, end_col int")]))


def brace_depth(corpus: DataFrame, lines: Callable[[Column], Column] = T.lines, ties: Sequence[str] = ()) -> DataFrame:
    """(path, line, depth): open blocks before each line, never below zero.

    Clamping is undone by running minima: the depth is the sum so far less its least value so far, if that is negative.
    Braces are taken one by one, since a line may close and open. Texts of one path are taken together, by lines, places in
    them and the columns `ties`.
    """
    text_lines = corpus.select("path", *ties, F.posexplode(lines(T.masked("text"))).alias("at", "masked"))
    steps = text_lines.select("path", "at", *ties, F.posexplode_outer(F.regexp_extract_all("masked", F.lit("[{}]"), F.lit(0))).alias("k", "brace"))
    steps = steps.withColumn("k", F.coalesce("k", F.lit(0)))
    value = F.when(F.col("brace") == "{", 1).when(F.col("brace") == "}", -1).otherwise(0)
    order = Window.partitionBy("path").orderBy("at", "k", *ties)
    run = steps.withColumn("sum", F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("low", F.least(F.lit(0), F.min("sum").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    after = run.groupBy("path", "at").agg(F.min_by(F.col("sum") - F.col("low"), F.struct(-F.col("k"), *ties)).alias("after"))
    before = F.lag("after", 1, 0).over(Window.partitionBy("path").orderBy("at"))
    return after.select("path", (F.col("at") + 1).alias("line"), before.cast("int").alias("depth"))


def brace_blocks(corpus: DataFrame, opening: str = "{", closing: str = "}") -> DataFrame:
    """(path, start_line, end_line, depth) of matched blocks.

    A block's opening and closing brace are successive braces of the same level once closing braces without an opening one
    are gone (those at which the running sum reaches a new low below zero).
    """
    pattern = f"[{T.quoted(opening)}{T.quoted(closing)}]"
    text_lines = corpus.select("path", F.posexplode(F.split(T.masked("text"), "\n", -1)).alias("at", "masked"))
    steps = text_lines.select("path", "at", F.posexplode(F.regexp_extract_all("masked", F.lit(pattern), F.lit(0))).alias("k", "brace"))
    order = Window.partitionBy("path").orderBy("at", "k")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("brace") == opening, 1).otherwise(-1)
    run = steps.withColumn("value", value).withColumn("sum", F.sum("value").over(up_to)).withColumn("low", F.least(F.lit(0), F.min("sum").over(up_to)))
    run = run.withColumn("low_before", F.lag("low", 1, 0).over(order)).where((F.col("value") == 1) | (F.col("low") == F.col("low_before")))
    level = F.col("sum") - F.col("low") + F.when(F.col("value") == 1, 0).otherwise(1)
    leveled = run.withColumn("depth", level.cast("int"))
    pairs = leveled.withColumn("end", F.lead("at").over(Window.partitionBy("path", "depth").orderBy("at", "k")))
    return pairs.where((F.col("value") == 1) & F.col("end").isNotNull()).select("path", (F.col("at") + 1).alias("start_line"), (F.col("end") + 1).alias("end_line"), "depth")


def unmatched_braces(corpus: DataFrame, opening: str = "{", closing: str = "}") -> DataFrame:
    """(path, unmatched_open, unmatched_close) of each file: what stays open at its end, and closes without an opening one.

    The sum of a prefix is carried as (open, missing): two neighbouring parts join without regard to where the split lies, so
    a file is folded in one row, without a shuffle.
    """
    braces = F.regexp_extract_all(T.masked("text"), F.lit(f"[{T.quoted(opening)}{T.quoted(closing)}]"), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("m"))

    def step(acc: Column, brace: Column) -> Column:
        up = brace == opening
        return F.struct(F.when(up, acc["o"] + 1).otherwise(F.greatest(acc["o"] - 1, F.lit(0))).alias("o"), (acc["m"] + F.when(~up & (acc["o"] == 0), 1).otherwise(0)).alias("m"))

    folded = corpus.where("text is not null").select("path", F.aggregate(braces, start, step).alias("x"))
    return folded.select("path", F.col("x.o").alias("unmatched_open"), F.col("x.m").alias("unmatched_close"))
