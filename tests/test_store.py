"""Intermediate tables are gone after a purge. In a session of its own process, as it deletes an application's tables."""

import os
import subprocess
import sys

CODE = """
import sys
from pyspark.sql import SparkSession
from prosegrain.operators.store import purge, shared_folder, written
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
assert written(spark.range(3), "some").count() == 3
import pathlib
folder = pathlib.Path(shared_folder(spark).removeprefix("file://"))
assert [p.name[:5] for p in folder.iterdir()] == ["some-"]
purge(spark)
assert not folder.exists() and pathlib.Path(sys.argv[1]).exists()
purge(spark)
"""


def test_purge(tmp_path):
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], cwd=top, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
