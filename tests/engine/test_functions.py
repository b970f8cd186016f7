import fnmatch
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.config import Limits, Settings, load_settings
from gleanery.errors import InvalidArgument, PathBlocked
from gleanery.functions import paths
from gleanery.functions import text as T

STRANGE = ["", "a", "a\n", "\n", "a\r\nb", "a\rb\n\n", "a\x0bb\x0cc", "x\x1cy\x1dz\x1e", "p\x85q\u2028r\u2029", "é\n\nß", "a\r\n\r\nb\r"]


def column(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string").select("i", expr.alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_lines_are_those_of_the_universal_split(spark):
    assert [list(x) for x in column(spark, STRANGE, T.lines("t"))] == [s.splitlines() for s in STRANGE]


def test_tokens(spark):
    assert column(spark, ["Foo_1 bar-BAZ é \u212a", ""], T.tokens("t")) == [["foo_1", "bar", "baz"], []]


def scanner(text):
    """Comments and strings made blank, one character at a time."""
    out, i = list(text), 0
    marks = ["//", "#", "/*", "'''", '"""', "'", '"', "`"]
    ends = {"//": "\n", "#": "\n", "/*": "*/"}
    while i < len(text):
        mark = next((m for m in marks if text.startswith(m, i)), None)
        if mark is None:
            i += 1
            continue
        start, end = i, ends.get(mark, mark)
        i += len(mark)
        while i < len(text) and not text.startswith(end, i):
            i += 2 if text[i] == "\\" and len(mark) == 1 and mark != "#" else 1
        i = min(len(text), i) if end == "\n" else min(len(text), i + len(end))
        for k in range(start, i):
            if out[k] != "\n":
                out[k] = " "
    return "".join(out)


def test_masks_equal_a_scanner(spark):
    import random

    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "\n", "'", '"', "`", "\\", "/", "*", "#", "//", "/*", "*/", "'''", '"""', " {", "}"]) for _ in range(rnd.randrange(40))) for _ in range(1500)]
    texts += ["const a = `x // y`; // z\nlet b", "start /* open\n end", '"' + "x" * 300_000 + '" y', "'\\" * 50_000]
    assert column(spark, texts, T.masked("t")) == [scanner(t) for t in texts]


def test_masks_with_other_rules(spark):
    pattern = T.mask_pattern(("--",), (), ("'",))
    got = column(spark, ["SELECT value -- not this\nFROM t 'or \" this'"], T.identifiers(T.masked("t", pattern)))
    assert got == [["SELECT", "value", "FROM", "t"]]


GLOBS = ["*", "*.py", "src/*.py", "src/**/*.py", "a?c", "[ab]*", "[!a]*", "x[", "*.[ch]", "a.b", "**/.git/**", "[]]x", "[a-c]z", ""]
NAMES = ["a.py", "src/a.py", "src/b/c.py", "abc", "b", "x[", "k.c", "aXb", "a.b", "q/.git/config", ".git/config", "]x", "bz", "new\nline.py", "A.PY", ""]


def test_globs_are_those_of_the_shell(spark):
    for g in GLOBS:
        want = [fnmatch.fnmatchcase(n, g) for n in NAMES]
        assert column(spark, NAMES, paths.matches_glob("t", g)) == want, g


@settings(max_examples=200, deadline=None)
@given(st.text("ab/.*?[]!-^", max_size=8), st.text("ab/.-^]!", max_size=8))
def test_glob_patterns(glob, name):
    if re.search(r"\[[^\]]*.-", glob):  # ranges in classes: bounds in order are fixed above
        return
    assert bool(re.match(paths.glob_regex(glob).replace("\\z", "\\Z"), name)) == fnmatch.fnmatchcase(name, glob)


def test_denied_hidden_and_test_paths(spark):
    names = [".env", "a/.ENV", "k/x.PEM", "id_rsa", "a/id_rsa.pub", "a/.git/x", "secrets.yaml", "src/app.py", "a/env", ".github/x"]
    assert column(spark, names, paths.denied("t")) == [True] * 7 + [False] * 3
    assert column(spark, names, paths.hidden("t")) == [True, True, False, False, False, True, False, False, False, True]
    assert column(spark, ["tests/a.py", "x/Tests/y.py", "a_test.py", "test_a.py", "contests/a.py"], paths.test_path("t")) == [True, True, True, False, False]
    assert column(spark, ["a.PY", ".env", "x/.b.c", "a/b", "a.tar.gz"], paths.suffix("t")) == [".py", "", ".c", "", ".gz"]


def test_component_order(spark):
    rows = spark.createDataFrame([(x,) for x in ("a-b", "a/b", "a")], "p string").orderBy(paths.parts("p")).collect()
    assert [r.p for r in rows] == ["a", "a/b", "a-b"]


def test_paths_that_lead_out_are_blocked():
    assert paths.resolve(r"src\a.py") == "src/a.py" and paths.resolve("./a//b") == "a/b"
    for bad in ("", " ", "/etc/passwd", "C:/x", "../x", "a/../../b"):
        with pytest.raises(PathBlocked):
            paths.resolve(bad)
    assert paths.normal_prefix("./a//b\\") == "a/b/"


def test_settings(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('[limits]\nmax_search_hits = 7\n[index]\ninclude_extensions = [".py"]\n[adapters]\npython_enabled = false\n')
    s = load_settings(f, {"limits": {"max_search_hits": 9}})
    assert s.limits.max_search_hits == 9 and s.include_extensions == (".py",) and not s.python_enabled
    for bad in ({"limits": {"max_file_bytes": 5 * 1024 * 1024}}, {"limits": {"max_references": True}}, {"security": {"denylist_relax": 1}}, {"index": {"exclude_globs": "x"}}):
        with pytest.raises(InvalidArgument):
            Settings().merged(bad)
    with pytest.raises(InvalidArgument):
        Limits(max_open_lines=0)


def test_evidence(spark):
    assert column(spark, ["  a\u00a0\t b  ", "x" * 200], T.squeezed("t")) == ["a b", "x" * 160]
    assert column(spark, ["  ", " a ", None], T.blank_to_null("t")) == [None, "a", None]
    assert column(spark, ["a\nb\nc\nd"], T.snippet(T.lines("t"))) == ["a\nb\nc"]
    assert F is not None
