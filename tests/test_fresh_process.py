"""The entry module in a process without a Spark session, with the training-data part and without it."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

LIST = """
import importlib, pkgutil
import __spark_entry__ as e
import chiasma
for m in pkgutil.walk_packages(chiasma.__path__, "chiasma."):
    if not m.name.endswith("__main__"):
        importlib.import_module(m.name)
from pyspark import SparkContext
assert SparkContext._active_spark_context is None
assert set(e.oracle_sql()) <= set(e.queries())
print("NAMES", len(e.queries()), sum(n.startswith("op") for n in e.queries()))
"""


def _names(folder):
    out = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    return [int(x) for x in out.stdout.split("NAMES")[1].split()]


def test_import_without_a_session():
    assert _names(ROOT)[0] > 60


def test_import_without_the_training_data_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "chiasma"), tmp_path / "chiasma", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    n, ops = _names(tmp_path)
    assert n > 60 and ops == 0
