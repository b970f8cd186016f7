from gleanery.operators import lexical, outline, references
from gleanery.plans import samples

OUTLINES = {
    "app/store.py": "class Store 5-16; method Store.load 8-13; function Store.load.check 10-11; async_method Store.save 15-16; function main 20-22",
    "lib/core.hpp": "namespace core 1-8; class Gear 2-6; method Gear.Gear 4-4; method Gear.turn 5-5; enum Mode 7-7",
    "lib/core.rs": "struct Core 1-1; trait Turn 2-4; impl Core 5-9; method Core.turn 6-8; const LIMIT 10-10; function helper 11-11",
    "srv/Main.java": "class org.sample.srv.Main 3-10; constructor org.sample.srv.Main.Main 5-5; method org.sample.srv.Main.twice 6-8; method org.sample.srv.Main.later 9-9; type org.sample.srv.Pair 11-11",
    "srv/main.go": "type srv.Server 3-5; const srv.Alpha 8-8; const srv.Beta 9-9; function srv.New 12-14; method srv.Server.Run 16-18",
    "web/view.ts": "interface View 1-3; class Panel 4-9; method Panel.constructor 5-5; async_method Panel.render 6-8; exported_variable DEFAULT 10-10; async_function draw 11-11",
    "win/Tool.cs": "namespace Win.Tools 1-1; class Win.Tools.Tool 3-16; property Win.Tools.Tool.Name 5-5; event Win.Tools.Tool.Changed 6-6; constructor Win.Tools.Tool.Tool 7-10; method Win.Tools.Tool.RunAsync 11-14; method Win.Tools.Tool.Build 15-15",
}


def corpus(spark, *files):
    return spark.createDataFrame(list(files), "path string, text string")


def shown(symbols):
    rows = sorted(symbols.collect(), key=lambda r: (r.path, r.start_line, r.end_line, r.name))
    out = {}
    for r in rows:
        out.setdefault(r.path, []).append(f"{r.kind} {r.name} {r.start_line}-{r.end_line}")
    return {p: "; ".join(x) for p, x in out.items()}


def test_outlines_of_all_languages(spark):
    symbols = outline.outline(samples.corpus(spark))
    order = lambda text: sorted(text.split("; "))
    assert {p: order(t) for p, t in shown(symbols).items()} == {p: order(t) for p, t in OUTLINES.items()}
    assert outline.violations(symbols).count() == 0
    row = {r.name: r for r in symbols.where("path = 'app/store.py'").collect()}
    assert row["Store"].doc == "Keeps rows." and row["Store"].signature == "(Base)"
    assert row["Store.load"].signature == "(self, path: str, *, strict: bool=False)" and row["Store.load.check"].decl_context == "if" and row["main"].is_conditional


def test_python_scopes_and_broken_files(spark):
    text = "if x:\n  def under_if(): pass\nclass Outer:\n  def method(self):\n    def local_fn(): pass\n    class Local:\n      def run(self): pass\nasync def top():\n  for i in y:\n    if i:\n      def under(): pass\n"
    rows = outline.outline(corpus(spark, ("a.py", text), ("b.py", "def x(:"), ("c.py", "a\0"), ("d.txt", "def y(): pass"))).collect()
    got = {r.name: (r.kind, r.scope_kind, r.decl_context) for r in rows}
    assert set(got) == {"under_if", "Outer", "Outer.method", "Outer.method.local_fn", "Outer.method.Local", "Outer.method.Local.run", "top", "top.under"}
    assert got["under_if"] == ("function", "module", "if") and got["top.under"] == ("function", "function", "for>if") and got["Outer.method.Local.run"][0] == "method"
    assert outline.outline(corpus(spark, ("a.py", "class A: pass")), python_enabled=False).count() == 0


def test_braces(spark):
    rows = lexical.brace_blocks(corpus(spark, ("x", "fn x() {\n  if (ok) {\n    }\n}}\n{\n"))).collect()
    assert sorted((r.start_line, r.end_line, r.depth) for r in rows) == [(1, 4, 1), (2, 3, 2)]
    depth = lexical.brace_depth(corpus(spark, ("x", "}}{\na\n}{{\nb"))).orderBy("line").collect()
    assert [r.depth for r in depth] == [0, 1, 1, 2]


def test_braces_against_a_stack(spark):
    import random

    rnd = random.Random(2)
    texts = [(str(i), "".join(rnd.choice("{}\na") for _ in range(rnd.randrange(60)))) for i in range(200)]
    want_blocks, want_depth = [], []
    for path, text in texts:
        stack, line = [], 1
        for c in text:
            if c == "\n":
                line += 1
            elif c == "{":
                stack.append(line)
            elif c == "}" and stack:
                want_blocks.append((path, stack.pop(), line, len(stack) + 1))
        level = 0
        for n, row in enumerate(text.splitlines(), 1):
            want_depth.append((path, n, level))
            for c in row:
                level = max(0, level + {"{": 1, "}": -1}.get(c, 0))
    assert sorted(map(tuple, lexical.brace_blocks(corpus(spark, *texts)).collect())) == sorted(want_blocks)
    assert sorted(map(tuple, lexical.brace_depth(corpus(spark, *texts)).collect())) == sorted(want_depth)


def symbols_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "symbol string")


def test_lexical_references(spark):
    text = 'import pkg.Tool;\nclass Tool {}\nvar t = new Tool();\nt.run();  // Tool()\nx.Tool.go()\nconst s = "Tool()";\nTool  (1)\nfor Tool in y\n'
    rows = references.lexical_references(corpus(spark, ("a.java", text)), symbols_of(spark, "Tool", "x.Tool", " Tool ", "")).collect()
    got = sorted((r.symbol, r.line, r.kind, r.confidence) for r in rows)
    assert got == [("Tool", 1, "import", "high"), ("Tool", 3, "instantiation", "high"), ("Tool", 7, "call", "medium")] + [("x.Tool", 1, "import", "high"), ("x.Tool", 3, "instantiation", "high"), ("x.Tool", 5, "read", "low"), ("x.Tool", 7, "call", "medium")]


def test_python_references(spark):
    text = "from a.b import Service\nclass Mine(Service): pass\nService()\nsvc.run()\nrun = Service\n"
    candidates = references.python_candidates(corpus(spark, ("a.py", text)))
    rows = references.python_references(candidates, symbols_of(spark, "Service", "Service.run")).collect()
    got = sorted((r.symbol, r.line, r.kind, r.evidence, r.confidence) for r in rows)
    assert got == sorted(
        [("Service", 1, "import", "from a.b import Service", "medium"), ("Service", 2, "inheritance", "class Mine(Service)", "high"), ("Service", 3, "instantiation", "Service()", "medium"), ("Service", 5, "read", "Service", "low"),
         ("Service.run", 4, "call", "svc.run()", "medium"), ("Service.run", 5, "write", "run = ...", "low")]
    )


def test_batches_equal_single_symbols(spark):
    rows = samples.corpus(spark)
    names = [r["name"] for r in outline.outline(rows).select("name").distinct().collect()]
    key = lambda df: sorted(map(str, df.collect()))
    both = key(references.references(rows, symbols_of(spark, *names)))
    single = [x for n in ("Store.load", "draw", "helper") for x in key(references.references(rows, symbols_of(spark, n)))]
    assert set(single) <= set(both)


def test_definitions(spark):
    symbols = outline.outline(samples.corpus(spark))
    got = outline.definitions(symbols, symbols_of(spark, "load", "Store.load", "Other.load", "Core"), 5).collect()
    assert sorted((r.symbol, r.path, r.start_line, r.total_candidates) for r in got) == [("Core", "lib/core.rs", 1, 2), ("Core", "lib/core.rs", 5, 2), ("Store.load", "app/store.py", 8, 1), ("load", "app/store.py", 8, 1)]


def test_lines_of_comments_are_not_tried_against_patterns():
    """Blank lines, which masked comments leave, took a time that grows with the square of their length."""
    import time

    from gleanery.operators.languages import READERS, Source

    for name, reader in READERS.items():
        start = time.process_time()
        assert list(reader(Source("\n".join([" " * 20_000] * 20)))) == [], name
        assert time.process_time() - start < 1, name


def test_texts_are_masked_once(spark):
    """A plan that filters and uses masked lines must not mask the texts for each use."""
    from gleanery.operators import lexical

    rows = spark.range(3).selectExpr("cast(id as string) path", "concat('a', id, ' // x\n// y\n  b') text")
    assert sorted(map(tuple, lexical.code_lines(rows).where("path = '1'").collect())) == [("1", 1, "a1     ", "a1 // x"), ("1", 3, "  b", "  b")]
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = lexical.source_lines(rows)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)
    assert plan.count("regexp_extract_all(") == 1, plan
