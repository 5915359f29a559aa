"""Executors must be able to run the model without this package on their path."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import functions as F
from cargoscope.operators.forest import isolation_scores
from cargoscope.session import local_session

spark = local_session("elsewhere", 2)
df = spark.range(50).select(F.col("id").cast("string").alias("k"), F.rand(1).alias("a"))
print("scored", isolation_scores(df, "k", ["a"], F.lit(True), n_trees=5).where("ml_score > 0").count())
"""


def test_model_runs_where_the_package_is_not_importable(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "scored 50" in run.stdout, run.stderr[-2000:]
