"""The driver contract can be read before any session exists, and the library does without the corpus folders."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 90"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_imports_the_corpus_operators():
    for path in (ROOT / "sonolith").rglob("*.py"):
        if "llm" not in path.parts:
            assert "sonolith.llm" not in path.read_text() and "import llm" not in path.read_text()
