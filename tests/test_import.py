"""The registry must be readable in a process that has no Spark session, with the optional subpackage and without it."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; from pyspark import SparkContext; q, o = e.queries(), e.oracle_sql(); assert SparkContext._active_spark_context is None; assert set(o) <= set(q); print(len(q), sum(n.startswith('op') for n in q))"


def names(folder: Path) -> list[int]:
    done = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
    assert done.returncode == 0, done.stderr[-2000:]
    return [int(x) for x in done.stdout.split()]


def copy(folder: Path) -> Path:
    shutil.copytree(REPO, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    return folder


def test_without_a_session():
    assert names(REPO)[0] > 200


def test_without_the_optional_subpackage(tmp_path):
    folder = copy(tmp_path / "repo")
    shutil.rmtree(folder / "tidemark" / "llm", ignore_errors=True)
    (folder / "corpus_pipeline.py").unlink(missing_ok=True)
    n, ops = names(folder)
    assert n > 200 and ops == 0
