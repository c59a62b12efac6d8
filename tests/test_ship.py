"""The entry point works from any working directory: Python workers get the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
for name in ("e9_cosine_neighbours", "m4_gaussian_vector_bayes"):
    found = [q for q in e.queries() if q.startswith(name.split("_")[0] + "_")][0]
    assert e.queries()[found](spark, "/root/testdata/sf0.001").count() > 0
print("shipped")
"""


def test_queries_run_from_another_directory(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=env,
                         capture_output=True, text=True)
    assert "shipped" in out.stdout, out.stderr[-2000:]
