"""Uses of symbols across files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.contract import guarded
from gleanery.operators import lexical, pysource
from gleanery.operators.languages import FALLBACK
from gleanery.operators.outline import language, short
from gleanery.operators.sizes import if_small
from gleanery.operators.topk import first_with_totals

REFERENCES = ["symbol", "path", "line", "kind", "evidence", "strategy", "confidence"]

# Words that mark a line.
IMPORT_HINT = r"(?U)\b(import|from|using|use|require|include)\b"
INHERITANCE_HINT = r"(?U)\b(extends|implements|inherits|:\s*public|:\s*private)\b"
DECLARATION_HINT = r"(?U)\b(class|struct|interface|enum|record|trait|type|namespace|package|module|impl|func|fn|def)\b"
RUN = "[A-Za-z0-9_$]"
BEFORE, AFTER = "(?<![A-Za-z0-9_$])", "(?![A-Za-z0-9_$])"


def _literal(c: Column) -> Column:
    return F.regexp_replace(c, r"([^A-Za-z0-9_])", r"\\$1")


def lexical_symbols(symbols: DataFrame) -> DataFrame:
    """(symbol, short, sequence): the last part of a symbol split at dots and colons, and a pattern of all parts if there are more."""
    rows = symbols.select(T.blank_to_null("symbol").alias("symbol")).where("symbol is not null").distinct()
    split = F.filter(F.split("symbol", "[.:]+"), lambda p: p != "")
    rows = rows.withColumn("parts", split).where(F.size("parts") > 0)
    sequence = F.when(F.size("parts") > 1, F.concat(F.lit(BEFORE), F.array_join(F.transform("parts", _literal), r"(?U)\s*(?:\.|::)\s*"), F.lit(AFTER)))
    return rows.select("symbol", F.element_at("parts", -1).alias("short"), sequence.alias("sequence"))


def lexical_references(corpus: DataFrame, symbols: DataFrame) -> DataFrame:
    """References in a corpus (path, text) to symbols (symbol), all in the JVM.

    Lines are indexed by their identifiers and equi-joined with the symbols' last parts; patterns are only tried on those. A
    line counts if all parts stand in sequence, or the last part is called, created, or in an import or inheritance line;
    lines that look like declarations don't.
    """
    rows = lexical.code_lines(corpus).withColumn("short", F.explode(F.array_distinct(T.identifiers("masked"))))
    return judged(rows.join(if_small(lexical_symbols(symbols)), "short"))


def judged(met: DataFrame) -> DataFrame:
    """References among lines (path, line, masked, original) that have a symbol's last part as an identifier (symbol, short, sequence)."""
    # patterns are literals, compiled once: they find names, which are then compared; only a name after `new`, whose end is a matter of word boundaries, is tried by itself
    every = lambda pattern, group: F.regexp_extract_all("masked", F.lit(pattern), F.lit(group))
    called = F.exists(every(rf"({RUN}++)(?U)\s*\(", 1), lambda x: x.endswith(F.col("short")))
    new = F.exists(every(rf"(?U)\bnew\s+({RUN}++)", 1), lambda x: x.startswith(F.col("short")))
    created = F.when(new, F.regexp_like("masked", F.concat(F.lit(r"(?U)\bnew\s+"), _literal(F.col("short")), F.lit(r"\b")))).otherwise(False)
    imports, inherits, declares = (F.col("masked").rlike(p) for p in (IMPORT_HINT, INHERITANCE_HINT, DECLARATION_HINT))
    alone = F.array_contains(every(f"{RUN}+", 0), F.col("short"))
    in_sequence = F.when(F.col("sequence").isNull(), False).otherwise(F.coalesce(F.regexp_like("masked", F.col("sequence")), F.lit(False)))
    signs = {"alone": alone, "called": called, "created": created, "imports": imports, "inherits": inherits, "declares": declares, "in_sequence": in_sequence}
    kept = met.withColumns(signs).where("(in_sequence or (alone and (called or created or imports or inherits))) and not (declares and alone)")
    imports, inherits, created, called = (F.col(c) for c in ("imports", "inherits", "created", "called"))
    kind = F.when(imports, "import").when(inherits, "inheritance").when(created, "instantiation").when(called, "call").otherwise("read")
    confidence = F.when(imports | inherits | created, "high").when(called, "medium").otherwise("low")
    out = kept.select("symbol", "path", "line", kind.alias("kind"), T.squeezed("original").alias("evidence"), F.lit("lexical").alias("strategy"), confidence.alias("confidence"))
    return out.where("evidence <> ''")


def python_candidates(corpus: DataFrame) -> DataFrame:
    """(path, line, candidate, kind, evidence, confidence) of Python files; parsed one by one, broken ones give nothing."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                tree = pysource.parsed(r.text)
                out += [(r.path, *u) for u in pysource.uses(tree)] if tree else []
            yield pd.DataFrame(out, columns=["path", "line", "candidate", "kind", "evidence", "confidence"]).astype({"line": "int32"})

    return corpus.select("path", "text").mapInPandas(run, "path string, line int, candidate string, kind string, evidence string, confidence string")


def python_references(candidates: DataFrame, symbols: DataFrame) -> DataFrame:
    """References by equal last part; a qualified candidate that isn't the symbol itself is of medium confidence."""
    asked = symbols.select(T.blank_to_null("symbol").alias("symbol")).where("symbol is not null").distinct().withColumn("short", short("symbol"))
    met = candidates.withColumn("short", short("candidate")).join(asked, "short")
    qualified = (F.col("candidate") != F.col("symbol")) & F.col("candidate").contains(".")
    return met.select("symbol", "path", "line", "kind", "evidence", F.lit("ast").alias("strategy"), F.when(qualified, "medium").otherwise(F.col("confidence")).alias("confidence"))


def references(corpus: DataFrame, symbols: DataFrame, python_enabled: bool = True) -> DataFrame:
    """References in all files that some language claims."""
    tagged = corpus.where("text is not null").withColumn("language", language("path", python_enabled))
    code = tagged.where(~F.col("language").isin("python", FALLBACK))
    return lexical_references(code, symbols).unionByName(python_references(python_candidates(tagged.where("language = 'python'")), symbols)).select(*REFERENCES)


def _broken() -> Column:
    blank = lambda c: T.blank_to_null(c).isNull()
    odd = ~F.coalesce(F.col("strategy").isin("ast", "lexical") & F.col("confidence").isin("high", "medium", "low"), F.lit(False))
    return blank("symbol") | blank("path") | blank("kind") | blank("evidence") | F.coalesce(F.col("line") < 1, F.lit(True)) | odd


def violations(found: DataFrame) -> DataFrame:
    """References that break the contract: blank fields, lines before the first, unknown strategies or confidences."""
    return found.where(_broken())


def checked(found: DataFrame) -> DataFrame:
    """References, with an error where one breaks the contract; no pass of its own."""
    return guarded(found, _broken(), "A reference breaks the contract.")


def profile(corpus: DataFrame, found: DataFrame, python_enabled: bool = True) -> DataFrame:
    """Per language of a corpus (path, text): files, characters, references found in them, by strategy, and the files that have some."""
    files = corpus.select("path", F.length("text").alias("chars"), language("path", python_enabled).alias("language"))
    each = found.groupBy("path").agg(F.count("*").alias("references"), F.count_if(F.col("strategy") == "ast").alias("ast"))
    joined = files.join(each, "path", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return joined.groupBy("language").agg(F.count("*").alias("files"), zero("chars").alias("chars"), F.count("references").alias("files_with_references"), zero("references").alias("references"), zero("ast").alias("ast"))


def limited(found: DataFrame, top_k: int) -> DataFrame:
    """The first references of each symbol by path, line, symbol and kind, with rank, total_candidates and truncated."""
    ranked = first_with_totals(found, "symbol", ["path", "line", "kind", "evidence", "confidence"], top_k)
    return ranked.withColumnRenamed("total", "total_candidates").withColumn("truncated", F.col("total_candidates") > top_k)
