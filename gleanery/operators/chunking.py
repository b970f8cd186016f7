"""Overlapping line chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.errors import InvalidArgument
from gleanery.functions import text as T

CHUNK_LINES, OVERLAP_LINES = 200, 30


def chunks(corpus: DataFrame, chunk_lines: int = CHUNK_LINES, overlap_lines: int = OVERLAP_LINES) -> DataFrame:
    """(path, start_line, end_line, chunk_id, text) of a corpus (path, text): windows of lines that overlap, numbered from 1.

    No shuffle: windows are counted from the number of lines and exploded. Texts without lines have no chunks.
    """
    if chunk_lines < 1 or not 0 <= overlap_lines < chunk_lines:
        raise InvalidArgument("0 <= overlap_lines < chunk_lines is required")
    step = chunk_lines - overlap_lines

    def ranges(lines: Column) -> Column:
        n = F.size(lines)
        count = F.when(n <= chunk_lines, F.lit(1)).otherwise(F.lit(1) + F.ceil((n - chunk_lines) / F.lit(step)).cast("int"))
        each = F.transform(F.sequence(F.lit(0), count - 1), lambda at: F.struct((at * step + 1).alias("start_line"), F.least(at * step + chunk_lines, n).alias("end_line")))
        return F.transform(F.when(n > 0, each), lambda r: F.struct(r["start_line"].alias("start_line"), r["end_line"].alias("end_line"), T.line_slice(lines, r["start_line"], r["end_line"]).alias("text")))

    # the generator takes an expression of `lines`, not of a text or a bare column, so that a text is split once
    rows = corpus.select("path", T.lines("text").alias("lines")).select("path", F.inline(ranges(F.col("lines"))))
    return rows.select("path", "start_line", "end_line", T.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("text")).alias("chunk_id"), "text")
