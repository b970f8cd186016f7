import random

import pytest

from gleanery.llm import line_dedup


def brute(rows, n, long_words=None):
    """(text, longest run) after dedup, by the longest run that begins at each line and at an earlier one too."""
    at, lines = [], []
    for _, text in rows:
        lines.append((text or "").split("\n") if text is not None else [])
        at.append([i for i, x in enumerate(lines[-1]) if x.strip(" \t\n\v\f\r")])
    bodies = [[lines[d][i] for i in at[d]] for d in range(len(rows))]
    seen, starts, out = {}, {}, []
    for d, body in enumerate(bodies):
        gone, longest = set(), 0
        for k, line in enumerate(body):
            run = 0
            for e, j in starts.get(line, []):
                m = 0
                while k + m < len(body) and j + m < len(bodies[e]) and body[k + m] == bodies[e][j + m]:
                    m += 1
                run = max(run, m)
            if run >= n:
                gone |= set(range(k, k + run))
                longest = max(longest, run)
            if run and long_words is not None and len(line.split()) >= long_words:
                gone.add(k)
            starts.setdefault(line, []).append((d, k))
        cut = {at[d][k] for k in gone}
        text = rows[d][1]
        out.append((text if not cut else "" if len(cut) == len(at[d]) else "\n".join(x for i, x in enumerate(lines[d]) if i not in cut), longest, len(cut)))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_against_brute_force(docs, n):
    rnd = random.Random(n)
    rows = [(i, "\n".join(rnd.choice("ab cd e".split(" ") + ["", " ", "fg"]) for _ in range(rnd.randrange(12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, rows[7][1]), (104, "\n".join(["x"] * 40)), (105, "x" * 200_000)]
    long = [f"l{i}" for i in range(40)]
    rows += [(110, "\n".join(long)), (111, "\n".join(long[3:30] + ["y"] + long[5:33])), (112, "\n".join(["z", *long[10:21], "ab", *long[1:8]]))]
    got = {r.doc_id: (r.text, r.longest_run, r.n_removed) for r in line_dedup.dedup_lines(docs(rows), n, long_words=None).collect()}
    assert got == {i: t for (i, _), t in zip(rows, brute(rows, n), strict=True)}


def test_single_long_lines(docs):
    rnd = random.Random(2)
    line = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    long, short = line(20), line(19)
    rows = [(1, f"{line(5)}\n{long}\n{short}\n{line(4)}\n{long}"), (2, f"{short}\n{line(3)}"), (3, f"{line(5)}\n{long}\n\n{line(6)}"), (4, f"\n{long}"), (5, ""), (6, None)]
    want = brute(rows, 2, 20)
    assert want[0][0].count(long) == 1 and want[3][0] == "" and want[1][0] == rows[1][1]
    got = {r.doc_id: (r.text, r.longest_run, r.n_removed) for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == {i: t for (i, _), t in zip(rows, want, strict=True)}


def test_one_long_run_in_many_documents(docs):
    run = "\n".join(f"line {i}" for i in range(100))
    rows = [(i, f"head {i}\n{run}\ntail {i}") for i in range(40)]
    got = {r.doc_id: (r.text, r.longest_run) for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == {i: (t, 0) if i == 0 else (f"head {i}\ntail {i}", 100) for i, t in rows}


def test_columns_named_as_helpers_stay(spark, docs, tmp_path):
    names = ["uid", "of", "gone", "n", "longest", "uid_", "rank", "first", "pos"]
    table = docs([(1, "a\nb\nc"), (2, "a\nb\nc")]).selectExpr("doc_id", "text", *(f"'v' as {x}" for x in names if x != "uid"), "'v' as uid")
    table.write.parquet(str(tmp_path / "named"))
    table = spark.read.parquet(str(tmp_path / "named"))
    out = line_dedup.dedup_lines(table, report=False)
    assert out.columns == table.columns
    assert all(set(r[2:]) == {"v"} for r in out.collect())


def test_two_results_read_in_any_order(docs):
    one, two = (line_dedup.dedup_lines(docs([(1, f"a\nb{k}"), (2, f"a\nb{k}")]), report=False) for k in range(2))
    assert two.count() == one.count() == 2


def test_repeated_rows_nulls_and_columns(docs):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nd"), (None, None)]
    table = docs(rows)
    out = line_dedup.dedup_lines(table, report=False)
    assert out.columns == table.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == [("1", ""), ("1", "a\nb\nc"), ("None", "None"), ("None", "d")]


def test_report_and_empty(docs):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "q\na\nb\nc\nd\ne")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.longest_run) for r in line_dedup.dedup_lines(docs(rows)).collect()}
    assert got == {1: ("a\nb\nc\nd\ne", 5, 0, 0), 2: ("q", 6, 5, 5)}
    assert line_dedup.dedup_lines(docs([])).collect() == []


def test_plans_do_not_grow_with_the_longest_run(docs, monkeypatch):
    joins = {}

    def counted(df, name, own=line_dedup.kept):
        joins[name] = max(joins.get(name, 0), df._jdf.queryExecution().analyzed().toString().count("Join "))
        return own(df, name)

    monkeypatch.setattr(line_dedup, "kept", counted)
    most = []
    for n in (3, 40):
        joins.clear()
        run = "\n".join(f"line {i}" for i in range(n))
        got = {r.doc_id: r.longest_run for r in line_dedup.dedup_lines(docs([(1, run), (2, f"x\n{run}")])).collect()}
        assert got == {1: 0, 2: n}
        most.append(max(joins.values()))
    assert most[0] == most[1]
