"""Texts: tokens, lines, masks, signatures. All are expressions of the JVM, none a Python function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that define a token, an identifier and a line.
TOKEN = "[A-Za-z0-9_]+"
IDENTIFIER = "[A-Za-z_$][A-Za-z0-9_$]*"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
#: Comments and strings, in the order in which they are tried.
LINE_COMMENTS = ("//", "#")
BLOCK_COMMENTS = (("/*", "*/"),)
STRING_DELIMITERS = ("'''", '"""', "'", '"', "`")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """Word tokens in order, lower-cased. They are found first, so letters that only become ASCII in lower case don't count."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once a row, where plans repeat what an expression uses twice, as they do in generators."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lines(text: str | Column) -> Column:
    """Lines at any of Unicode's breaks; a break at the end adds no empty line, and an empty text has none."""
    ended = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return once(F.split(col(text), LINE_BREAK, -1), ended)


def snippet(text_lines: str | Column) -> Column:
    """The first three lines, 300 characters at most."""
    return F.substring(F.array_join(F.slice(col(text_lines), 1, 3), "\n"), 1, 300)


def line_slice(text_lines: str | Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1, both included, joined."""
    return F.array_join(F.slice(col(text_lines), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def chunk_id(path: Column, start: Column, end: Column, payload: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, start.cast("string"), end.cast("string"), payload), 256)


def squeezed(text: str | Column, limit: int = 160) -> Column:
    """White space as single blanks, cut to a length."""
    return F.substring(F.trim(F.regexp_replace(col(text), r"(?U)\s+", " ")), 1, limit)


def blank_to_null(text: str | Column) -> Column:
    trimmed = F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def quoted(text: str) -> str:
    """A literal for Java's regular expressions."""
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else f"\\{c}" for c in text)


def mask_pattern(line_comments=LINE_COMMENTS, blocks=BLOCK_COMMENTS, strings=STRING_DELIMITERS) -> str:
    """One alternation that finds comments and strings from left to right, as a scanner would.

    Repeats are possessive, so that long strings don't exhaust the matcher's stack. Only delimiters of one character know
    the backslash; whatever is not closed runs to the end.
    """
    parts = [f"(?:{'|'.join(map(quoted, line_comments))})[^\\n]*"] if line_comments else []
    parts += [f"{quoted(a)}[\\s\\S]*?(?:{quoted(b)}|\\z)" for a, b in blocks]
    for q in sorted(strings, key=len, reverse=True):
        if len(q) > 1:
            parts.append(f"{quoted(q)}[\\s\\S]*?(?:{quoted(q)}|\\z)")
        else:
            parts.append(f"{quoted(q)}(?:[^{quoted(q)}\\\\]++|\\\\[\\s\\S])*+(?:{quoted(q)}|\\\\?\\z)")
    return "|".join(f"(?:{p})" for p in parts)


def masked(text: str | Column, pattern: str | None = None) -> Column:
    """text with every character of comments and strings but line feeds made blank; places stay the same."""
    pattern = pattern or mask_pattern()
    code, hidden = F.split(col(text), pattern, -1), F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))
    blanks = lambda b: F.when(F.contains(b, F.lit("\n")), F.regexp_replace(b, "[^\n]", " ")).otherwise(F.repeat(F.lit(" "), F.length(b)))
    return F.array_join(F.zip_with(code, hidden, lambda a, b: F.concat(a, F.coalesce(blanks(b), F.lit("")))), "")


def identifiers(text: str | Column) -> Column:
    return F.regexp_extract_all(col(text), F.lit(IDENTIFIER), F.lit(0))


def iso_millis(ts: str | Column) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
