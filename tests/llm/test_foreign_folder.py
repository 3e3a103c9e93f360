"""Every operator runs in a session of its own that was started outside the repository."""

import os
import subprocess
import sys
import tempfile

import pytest

from seriesloom.llm.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spec = importlib.util.spec_from_file_location("entry", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
print("rows", entry.queries()[sys.argv[2]](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_runs_from_another_folder(name):
    with tempfile.TemporaryDirectory() as folder:
        done = subprocess.run(
            [sys.executable, "-c", SCRIPT, ROOT, name], cwd=folder, capture_output=True, text=True, timeout=600,
            env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
        )
    assert done.returncode == 0 and "rows " in done.stdout, done.stderr[-2000:]
