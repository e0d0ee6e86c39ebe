"""What is outside the training-data subpackage works without it."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q), len(q))"


@pytest.mark.parametrize("gone", [("bytewren/llm", "tests/llm"), ("bytewren/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_imports(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis"))
    for name in gone:
        there = copy / name
        if there.is_dir():
            shutil.rmtree(there)
        else:
            there.unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=env, capture_output=True, text=True, check=True).stdout.split()
    left = len(list((copy / "bytewren" / "llm").glob("queries.py"))) * 10
    assert int(found[0]) == left and int(found[1]) > 100
    collected = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests", "--ignore=tests/llm", "--ignore=tests/test_removal.py"], cwd=copy, env=env, capture_output=True, text=True)
    assert collected.returncode == 0, collected.stdout
