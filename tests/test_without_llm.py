"""The rest of the library stands alone where the document operators and their tests are gone."""
from __future__ import annotations

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_document_operators(tmp_path):
    """With and without corpus_pipeline.py, which needs them: every other query stays registered, and the package imports."""
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache", "*.json"))
    code = ("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); "
            "assert len(q) > 200 and 'pipeline' not in q and not any(k.startswith('op') and '_' in k and k[2].isdigit() for k in q); "
            "assert set(s) <= set(q); import check, bench; print(len(q))")
    # a file that wants the operators must not matter either
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for _ in range(2):
        done = subprocess.run([sys.executable, "-W", "error::SyntaxWarning", "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        if (copy / "corpus_pipeline.py").exists():
            os.remove(copy / "corpus_pipeline.py")
