"""Python kernels reach the workers without a copy of the package on their path."""

import os
import subprocess
import sys

from .conftest import ROOT, SF001

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})          # the driver finds the package; the workers do not
from reelspark.plans import QUERIES
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
sys.path.remove({ROOT!r})
print("ROWS", QUERIES["token_bucket"](spark, {SF001!r}).count(), QUERIES["token_reuse"](spark, {SF001!r}).count())
"""


def test_fold_runs_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    rows = [line for line in out.stdout.splitlines() if "ROWS" in line]
    assert rows and int(rows[0].split()[-2]) > 0, out.stderr[-2000:]
