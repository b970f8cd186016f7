"""The identifier index: where each name stands, and references found through it without reading sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.operators import references
from gleanery.operators.languages import FALLBACK
from gleanery.operators.outline import short
from gleanery.operators.sizes import if_small

#: So many names or paths are looked up by a filter that the scan uses to skip row groups; more are joined.
FEW = 500


def build(texts: DataFrame) -> DataFrame:
    """(name, path, lines) of texts (path, language, text, masked): the lines, ascending, of each name outside comments and strings.

    Of languages that are read by patterns; a file whose masked and original lines don't pair up has no names.
    """
    code = texts.where(~F.col("language").isin("python", FALLBACK))
    both = code.select("path", T.lines("masked").alias("masked"), F.size(T.lines("text")).alias("n")).where(F.size("masked") == F.col("n"))
    rows = both.select("path", F.posexplode("masked").alias("at", "line")).select("path", (F.col("at") + 1).alias("line"), F.explode(F.array_distinct(T.identifiers("line"))).alias("name"))
    return rows.groupBy("name", "path").agg(F.array_sort(F.collect_list("line")).alias("lines"))


def looked_up(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """rows whose column is in wanted (same column): by a filter if wanted is few, else by a join."""
    few = [r[0] for r in wanted.select(column).distinct().limit(FEW + 1).collect()]
    return rows.where(F.col(column).isin(few)) if len(few) <= FEW else rows.join(if_small(wanted.select(column).distinct()), column, "left_semi")


def lexical_references(names: DataFrame, texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """references.lexical_references() by the index: only texts that have a symbol's last part are opened, and of these only its lines."""
    wanted = references.lexical_symbols(symbols)
    met = looked_up(names, "name", wanted.select(F.col("short").alias("name"))).join(if_small(wanted.withColumnRenamed("short", "name")), "name")
    by_path = met.groupBy("path").agg(F.collect_list(F.struct("symbol", F.col("name").alias("short"), "sequence", "lines")).alias("hits"))  # as many as symbols are asked for
    opened = looked_up(texts.select("path", "text", "masked"), "path", by_path).join(by_path, "path")
    rows = opened.select("path", "hits", T.lines("masked").alias("m"), T.lines("text").alias("o"))
    at = lambda lines, n: F.get(F.col(lines), n - 1)
    each = F.flatten(F.transform("hits", lambda h: F.transform(h["lines"], lambda n: F.struct(h["symbol"].alias("symbol"), h["short"].alias("short"), h["sequence"].alias("sequence"), n.alias("line"), at("m", n).alias("masked"), at("o", n).alias("original")))))
    return references.judged(rows.select("path", F.explode(each).alias("x")).select("path", "x.*"))


def python_references(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """references.python_references() over stored uses, which have their last part (short)."""
    asked = symbols.select(short(T.blank_to_null("symbol")).alias("short")).where("short is not null")
    return references.python_references(looked_up(uses, "short", asked).drop("short"), symbols)


def stored_references(names: DataFrame, texts: DataFrame, uses: DataFrame, symbols: DataFrame) -> DataFrame:
    return lexical_references(names, texts, symbols).unionByName(python_references(uses, symbols)).select(*references.REFERENCES)
