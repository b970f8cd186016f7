"""Declared symbols of source files, and definition lookup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.contract import guarded
from gleanery.functions.text import col
from gleanery.operators import pysource
from gleanery.operators.languages import FALLBACK, READERS, SUFFIXES, Source
from gleanery.operators.topk import first_with_totals

SYMBOLS = "path string, language string, kind string, name string, signature string, start_line int, end_line int, doc string, parent_symbol string, scope_kind string, is_conditional boolean, decl_context string"

SCOPES = ("module", "class", "function")


def language(path: str | Column, python_enabled: bool = True) -> Column:
    out, low = F.when(F.lit(False), F.lit("")), F.lower(col(path))
    for name, suffixes in SUFFIXES.items():
        if name != "python" or python_enabled:
            out = out.when(low.rlike("(?:" + "|".join(T.quoted(s) for s in suffixes) + r")\z"), F.lit(name))
    return out.otherwise(F.lit(FALLBACK))


def _rows(path: str, lang: str, text: str, masked: str) -> Iterator[tuple]:
    if lang == "python":
        tree = pysource.parsed(text)
        for kind, name, signature, start, end, doc, parent, scope, conditional, context in pysource.declarations(tree) if tree else ():
            yield path, lang, kind, name, signature.strip() or None, start, end, doc, parent, scope, conditional, context
    elif lang in READERS:
        for f in READERS[lang](Source(masked)):
            scope = "class" if f.kind in ("method", "async_method", "constructor") else "module"
            parent = f.name.rpartition(".")[0] or None if scope == "class" else None
            yield path, lang, f.kind, f.name, f.signature, f.start, f.end, None, parent, scope, None, None


def outline(corpus: DataFrame, python_enabled: bool = True) -> DataFrame:
    """Symbols of a corpus (path, text; and masked, if that is stored). Masking is done in the JVM; files are parsed one by one, and one that can't be parsed has no symbols. A file's symbols
    stand together, by lines, name and kind."""
    names = [c.split()[0] for c in SYMBOLS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                try:
                    out += sorted(_rows(r.path, r.language, r.text, r.masked), key=lambda x: (x[5], x[6], x[3], x[2]))
                except Exception:  # whatever a reader stumbles over: its file has no symbols, others are not affected
                    continue
            made = pd.DataFrame(out, columns=names)
            yield made.astype({"start_line": "int32", "end_line": "int32", "is_conditional": "object"})

    hidden = F.col("masked") if "masked" in corpus.columns else T.masked("text")
    rows = corpus.where("text is not null").select("path", language("path", python_enabled).alias("language"), "text", hidden.alias("masked"))
    wanted = rows.where(F.col("language") != FALLBACK)
    python = F.col("language") == "python"
    blank = F.regexp_replace("masked", r"(?dm)^ ++(?=\n)", "")  # lines of comments alone
    return wanted.select("path", "language", F.when(python, F.col("text")).otherwise("").alias("text"), F.when(python, F.lit("")).otherwise(blank).alias("masked")).mapInPandas(run, SYMBOLS)


def short(symbol: str | Column) -> Column:
    return F.substring_index(col(symbol), ".", -1)


def definitions(symbols: DataFrame, requests: DataFrame, top_k: int) -> DataFrame:
    """Definitions of each request (symbol): equal names, or one is the bare last part of the other. Three equi-joins instead of a nested loop.

    Adds total_candidates, truncated and rank (by path, lines, name, kind).
    """
    asked = requests.select(F.trim("symbol").alias("symbol")).where("symbol <> ''").distinct()
    exact = symbols.join(asked, symbols.name == asked.symbol)
    bare = symbols.join(asked, symbols.name == short("symbol")).where(F.col("name") != F.col("symbol"))
    last = symbols.join(asked, short("name") == F.col("symbol")).where(F.col("name") != F.col("symbol")).where(F.col("name") != short("symbol"))
    found = exact.unionByName(bare).unionByName(last)
    wanted = found.select("symbol", "path", "start_line", "end_line", "kind", "name", "signature", "scope_kind")
    ranked = first_with_totals(wanted, "symbol", ["path", "start_line", "end_line", "name", "kind"], top_k).withColumnRenamed("total", "total_candidates")
    return ranked.withColumn("truncated", F.col("total_candidates") > top_k)


def ordered(symbols: DataFrame) -> DataFrame:
    """By path, then lines, name and kind: a distributed sort, since there may be as many symbols as the corpus has."""
    return symbols.orderBy("path", "start_line", "end_line", "name", "kind")


def _broken() -> Column:
    blank = lambda c: T.blank_to_null(c).isNull()
    scope = F.col("scope_kind").isNotNull() & ~F.col("scope_kind").isin(*SCOPES)
    return blank("kind") | blank("name") | F.coalesce(F.col("start_line") < 1, F.lit(True)) | F.coalesce(F.col("end_line") < F.col("start_line"), F.lit(True)) | scope


def violations(symbols: DataFrame) -> DataFrame:
    """Symbols that break the contract: blank names or kinds, lines out of order, or an unknown scope."""
    return symbols.where(_broken())


def checked(symbols: DataFrame) -> DataFrame:
    """symbols, with an error where one breaks the contract; no pass of its own."""
    return guarded(symbols, _broken(), "A symbol breaks the contract.")
