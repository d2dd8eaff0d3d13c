"""The library works without the optional subpackage and the pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
names = e.queries()
assert "median_table_dataset" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names), sorted(names)
assert set(e.oracle_sql()) <= set(names)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", e.entry(spark).count())
"""


@pytest.mark.parametrize("gone", [("lumaquery/llm", "tests/llm"), ("lumaquery/llm", "tests/llm", "corpus_pipeline.py")])
def test_deleted(tmp_path, gone):
    root = tmp_path / "repo"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
    for name in gone:
        at = root / name
        shutil.rmtree(at, ignore_errors=True) if at.is_dir() else at.unlink(missing_ok=True)
    env = os.environ | {"PYTHONPATH": str(root), "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=root, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
