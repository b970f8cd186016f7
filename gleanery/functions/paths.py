"""Paths: globs, suffixes, hidden and denied names."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.errors import PathBlocked
from gleanery.functions.text import col, quoted

# Names that are never read, whatever the settings.
DENIED_NAMES = (".env",)
DENIED_SUFFIXES = (".pem", ".key", ".pfx", ".p12")
DENIED_PREFIXES = ("id_rsa", "secrets.")
DENIED_DIRECTORY = ".git"


def glob_regex(glob: str) -> str:
    """A shell pattern as a whole-string regular expression: * crosses slashes, ? is one character, [..] a class. Case counts."""
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            j = i + 1 if i < len(glob) and glob[i] in "!^" else i
            j = glob.find("]", j + 1)
            if j < 0:
                out += r"\["
                continue
            body, i = glob[i:j], j + 1
            negated, body = body[0] == "!", body[1:] if body[0] == "!" else body
            kept = "".join(c if c.isalnum() or c == "-" else f"\\{c}" for c in body)
            out += f"[{'^' if negated else ''}{kept}]"
        else:
            out += quoted(c)
    return f"(?s)^(?:{out})\\z"


def matches_glob(path: str | Column, glob: str) -> Column:
    return col(path).rlike(glob_regex(glob))


def _plain(path: Column, glob: str) -> Column | None:
    """Whether a glob matches all of path, if it has stars at its ends alone: by comparing, not by a regular expression that goes back over a path for each star."""
    core = glob.strip("*")
    if any(c in core for c in "*?["):
        return None
    before, after = glob.startswith("*"), glob.endswith("*")
    if not core:
        return F.length(path) >= 0 if before else path == ""
    if before and after:
        return path.contains(F.lit(core))
    return path.endswith(F.lit(core)) if before else path.startswith(F.lit(core)) if after else path == core


def excluded(path: str | Column, globs: tuple[str, ...]) -> Column:
    """Whether some pattern matches the path, or the path after a slash."""
    found = F.lit(False)
    for one in (col(path), F.concat(F.lit("/"), col(path))):
        tests = [(g, _plain(one, g)) for g in globs]
        for _, test in tests:
            found = found if test is None else found | test
        if rest := [glob_regex(re.sub(r"\*+", "*", g)).removeprefix("(?s)^").removesuffix("\\z") for g, test in tests if test is None]:
            found = found | one.rlike(f"(?s)^(?:{'|'.join(rest)})\\z")
    return found


def whole_directories(globs: tuple[str, ...]) -> tuple[str, ...]:
    """Names of directories that patterns like **/name/** exclude with all below."""
    return tuple(m[1] for g in globs if (m := re.fullmatch(r"\*\*/([^/*?\[\]]+)/\*\*", g)))


def suffix(path: str | Column) -> Column:
    """The last suffix in lower case; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(col(path), r"[^/.][^/]*(\.[^./]+)$", 1))


def parts(path: str | Column) -> Column:
    """Path components; ordering by them is the order of paths, not of strings."""
    return F.split(col(path), "/")


def hidden(path: str | Column) -> Column:
    return F.exists(parts(path), lambda x: x.startswith("."))


def denied(path: str | Column) -> Column:
    low = F.lower(col(path))
    name = F.element_at(F.split(low, "/"), -1)
    found = name.isin(*DENIED_NAMES) | F.array_contains(F.split(low, "/"), DENIED_DIRECTORY)
    for s in DENIED_SUFFIXES:
        found = found | name.endswith(s)
    for p in DENIED_PREFIXES:
        found = found | name.startswith(p)
    return found


def block_reason(path: str | Column, size: str | Column, max_file_bytes: int) -> Column:
    """denylist, file_size, or null."""
    return F.when(denied(path), F.lit("denylist")).when(col(size) > max_file_bytes, F.lit("file_size"))


def test_path(path: str | Column) -> Column:
    low = F.lower(col(path))
    return F.concat(F.lit("/"), low, F.lit("/")).contains("/tests/") | low.endswith("_test.py")


def normal_prefix(prefix: str | None) -> str:
    """A path prefix with forward slashes, none doubled, and no ./ in front."""
    out = re.sub(r"/+", "/", (prefix or "").strip().replace("\\", "/"))
    while out.startswith("./"):
        out = out[2:]
    return out


def resolve(path: str, root: str | None = None) -> str:
    """A caller's path, relative to the root, in normal form; an absolute one must lie under the root. Blocks what is empty, elsewhere, or leads upwards."""
    out = path.strip().replace("\\", "/")
    if not out:
        raise PathBlocked("The path is empty.")
    if out.startswith("/") or re.match(r"^[A-Za-z]:/", out):
        whole, top = posixpath.normpath(out), posixpath.normpath(root.removeprefix("file://")) if root else None
        if top is None or not whole.startswith(top.rstrip("/") + "/"):
            raise PathBlocked("The path is outside the corpus.", "Use a path under the corpus root.")
        return posixpath.relpath(whole, top)
    if ".." in out.split("/"):
        raise PathBlocked("The path leads out of the corpus.", "Remove '..' segments.")
    return posixpath.normpath(out)
