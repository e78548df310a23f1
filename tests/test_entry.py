"""The entry point with and without its optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = "import __spark_entry__ as e; print(len([k for k in e.queries() if k[:2] != 'op' and k != 'pipeline']), 'pipeline' in e.queries(), len(e.oracle_sql()) > 0)"


@pytest.mark.parametrize("gone", [["trackframe/llm"], ["trackframe/llm", "corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        at = copy / name
        shutil.rmtree(at, ignore_errors=True) if at.suffix == "" else at.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, pipeline, sql = out.stdout.split()
    assert int(n) >= 161 and pipeline == "False" and sql == "True"


RUN = """
import os, sys
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
print("ROWS", e.entry(spark).count(), *(e.queries()[n](spark, e.FLAGSHIP_DIR).count() for n in ("udf1_score_batches", "src10_scan_keyed_matrix", "win6_running_sum")))
"""


def test_queries_run_without_optional_parts(tmp_path):
    """The flagship query, one with Python workers, one that writes, one by ordered cells."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    (copy / "corpus_pipeline.py").unlink()
    out = subprocess.run([sys.executable, "-c", RUN, f"file://{tmp_path}/shared"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    rows = list(map(int, out.stdout.split("ROWS")[1].split()))
    assert len(rows) == 4 and all(n > 0 for n in rows)
