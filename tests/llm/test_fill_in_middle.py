import hashlib
import re

import pytest

from gleanery.llm import fill_in_middle
from gleanery.llm import queries as catalogue

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def sample(doc_id, text):
    """The contract in plain Python, (n, form, prefix, middle, output)."""
    text = text or ""
    units, h = UNIT.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    d = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in d[:2])
    prefix, middle, suffix = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    assert prefix + middle + suffix == text
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or d[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if d[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(rows, source):
    want = sorted((str(i), *sample(i, t), t or "") for i, t in source)
    got = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in rows)
    assert got == want
    assert all(r.output_sha256 == sha(r.output) and r.restored_sha256 == sha(r.restored) for r in rows)


def test_against_plain_python(spark, docs):
    odd = ["", None, " ", "\n\t \x0b\x0c\r", "a", " a", "a ", "a b  c\n", "x <P> y z", "<M>", "a <S> b", " nbsp  em　", "é à 日本 語\U0001f600 z", "nul\0 in it", "< < <P <S <M > x < y", "<<P <<S <<M P> S> M>", "'quote' $unit \\1 % {}", "word " * 60_000, "x" * 200_000]
    rows = [(i, t) for i, t in enumerate(odd * 8)] + [(None, "null id"), (3, "repeated id a b c"), (3, "repeated id a b c"), (-7, "below zero a b")]
    found = fill_in_middle.transform(docs(rows)).collect()
    check(found, rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_small_ranges_and_empty_tables(spark, docs, monkeypatch):
    assert fill_in_middle.transform(docs([(1, "x")]).where("doc_id > 5")).collect() == []
    rows = [(i, "a b c d e " * (i % 50)) for i in range(300)]
    check(fill_in_middle.transform(docs(rows).repartition(7, "doc_id")).collect(), rows)
    bare = fill_in_middle.transform(docs(rows), texts=False)
    assert {(r.output, r.restored) for r in bare.collect()} == {(None, None)}


@pytest.mark.parametrize("name", ["op11_fill_in_middle"])
def test_query_over_the_whole_table(spark, name):
    sf = "/root/testdata/sf0.01"
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = catalogue.queries()[name](spark, sf).collect()
    assert len(rows) == len(source)
    for r in rows:
        n, form, prefix, middle, output = sample(r.doc_id, source[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(output), sha(source[r.doc_id] or ""))


def test_query_equals_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'").fetchall()
    want = con.sql(catalogue.oracle_sql()["op11_fill_in_middle"])
    columns = sorted(want.columns)
    key = lambda r: tuple(map(repr, r))
    found = catalogue.queries()["op11_fill_in_middle"](spark, sf)
    assert sorted(found.columns) == columns
    assert sorted(map(key, found.select(*columns).collect())) == sorted(map(key, want.select(*columns).fetchall()))
