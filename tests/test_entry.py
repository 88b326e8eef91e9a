"""The library without the operators for training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_without_training_operators(tmp_path):
    """Neither with the folder gone nor with it emptied does anything else depend on it."""
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    shutil.copytree(f"{ROOT}/lexispan", tmp_path / "lexispan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    ask = "import __spark_entry__ as e, lexispan.checks as c; assert set(e.queries()) == set(c.QUERIES) and set(e.oracle_sql()) == set(c.ORACLES); print(len(e.queries()))"
    for empty in (False, True):
        if empty:
            (tmp_path / "lexispan" / "llm").mkdir()
        run = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120)
        assert run.returncode == 0, run.stderr
        assert int(run.stdout) > 150
