"""The driver contract, also where the corpus operators have been taken out."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q); print('ok')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert done.stdout.strip() == "ok", done.stderr


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0 and rows.columns == ["name", "pid", "value", "n_frags", "normalized"]
    if (ROOT / "locuslake" / "llm").exists():
        names = __spark_entry__.queries()
        assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13
