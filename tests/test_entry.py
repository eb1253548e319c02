"""Driver contract: every registered query against its SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
import check
from ledgerlight.queries import all_oracles, all_queries

ORACLES = all_oracles()
# needs fits; the rows-only queries are covered by test_models
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con(small):
    return check.duck(small)


def test_contract(spark):
    df = entry.entry(spark)
    assert df.count() == 2981
    assert {r["summary_reason"] for r in df.select("summary_reason").distinct().collect()} == {"single_record", "segments_null_summary", "max_value"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, con, small, key):
    ok, message = check.compare(spark, con, QUERIES[key], ORACLES[key], small)
    assert ok, message


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",), ("ledgerlight/llm/__init__.py",)])
def test_entry_imports_without_the_optional_parts(tmp_path, left):
    """A copy without them, also one where only the pipeline, or an empty folder, stays."""
    top = os.path.dirname(os.path.abspath(entry.__file__))
    skip = shutil.ignore_patterns("llm", "__pycache__", ".git", "tests")
    copy = str(tmp_path / "copy")
    shutil.copytree(top, copy, ignore=skip)
    if "corpus_pipeline.py" not in left and os.path.exists(f"{copy}/corpus_pipeline.py"):
        os.remove(f"{copy}/corpus_pipeline.py")
    if "ledgerlight/llm/__init__.py" in left:
        os.makedirs(f"{copy}/ledgerlight/llm/__pycache__")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    got = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert got.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], got.stderr
