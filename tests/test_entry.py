"""The driver's entry works with and without the corpus parts."""

import pathlib
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from sessionlake.plans import registry

ROOT = pathlib.Path(entry.__file__).parent


def test_flagship(spark):
    assert entry.entry(spark).columns == ["symbol", "session_date", "open", "high", "low", "close", "volume"]


def test_oracles_belong_to_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert registry.QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_without_the_corpus_parts(tmp_path, pipeline_stays):
    """In a copy without the subpackage; the pipeline's file may or may not be there."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    assert not (copy / "sessionlake" / "llm").exists()
    if not pipeline_stays:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = """
import __spark_entry__ as entry
from sessionlake.plans import registry
assert entry.queries().keys() == registry.QUERIES.keys()
assert entry.oracle_sql() == registry.ORACLE_SQL
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stderr
