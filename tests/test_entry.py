import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_are_named_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q), set(o) - set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_core_does_not_import_the_training_data_operators():
    found = [p for p in (ROOT / "paperloom").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts and ("paperloom.llm" in p.read_text() or "from .llm" in p.read_text())]
    assert not found
