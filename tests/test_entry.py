"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from quern.plans import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["c_custkey", "c_mktsegment", "order_count"] and frame.count() == 7


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL) <= set(entry.queries())


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 100; assert not [n for n in e.queries() if n.startswith('op')]"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr
