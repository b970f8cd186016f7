import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_training_data_part(tmp_path):
    shutil.copytree(REPO / "gleanery", tmp_path / "gleanery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, gleanery.engine; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    n, *rest = out.stdout.split()
    assert int(n) >= 45 and rest == ["True", "False", "False"], out.stderr


def test_nothing_else_imports_it():
    for f in (REPO / "gleanery").rglob("*.py"):
        if "llm" not in f.relative_to(REPO).parts:
            assert "gleanery.llm" not in f.read_text(), f


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
