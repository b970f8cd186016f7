import fnmatch

from pyspark.sql import functions as F

from gleanery.config import EXCLUDE_GLOBS
from gleanery.functions import paths
from gleanery.functions import text as T
from gleanery.operators import outline

PATHS = ["", "a.py", "node_modules/x.js", "src/node_modules/y/x.js", "src/.git/config", "build", "a/build/b", "xbuild/c", "a\nb/dist/c.go", "[x]/a", "a**b", "tmp/a.log", "q/tmp/z.log", "/lead/x", "a]b"]
GLOBS = [*EXCLUDE_GLOBS, "*.log", "tmp/*", "build", "*", "**", "", "a?py", "[ax]*", "*/z.*", "***x***", "[x", "a**b", "/lead*", "*]*"]


def test_plain_patterns_are_compared_and_equal_the_shell(spark):
    rows = spark.createDataFrame([(p,) for p in [*PATHS, None]], "path string")
    for globs in (*((g,) for g in GLOBS), EXCLUDE_GLOBS, ("*.log", "a?py", "tmp/*"), ()):
        got = {r.path: r.x for r in rows.select("path", paths.excluded("path", globs).alias("x")).collect()}
        for p in PATHS:
            assert got[p] == any(fnmatch.fnmatchcase(x, g) for g in globs for x in (p, f"/{p}")), (p, globs)
        assert not globs or got[None] is None  # neither excluded nor kept
    plan = rows.where(~paths.excluded("path", EXCLUDE_GLOBS))._jdf.queryExecution().toString()
    assert "rlike" not in plan.lower()


def test_outline_takes_stored_masks(spark):
    go = "package gen\n\n// type Z struct {}\ntype T struct {\n}\n\nfunc make() *T {\n}\n"
    rows = spark.createDataFrame([("a.go", go), ("b.py", "def f():\n    pass\n")], "path string, text string")
    stored = rows.withColumn("masked", F.when(F.col("path") == "a.go", T.masked("text"))).localCheckpoint()
    found = outline.outline(stored)
    assert "regexp_extract_all" not in found._jdf.queryExecution().toString()
    assert sorted(found.collect()) == sorted(outline.outline(rows).collect()) and found.count() == 3
