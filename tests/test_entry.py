"""What a driver may do before there is a Spark session."""

from __future__ import annotations

import subprocess
import sys

from .conftest import ROOT

_ALL = """
import importlib, pkgutil
import __spark_entry__ as e
import mentionweave
from pyspark import SparkContext
for m in pkgutil.walk_packages(mentionweave.__path__, "mentionweave."):
    importlib.import_module(m.name)
assert set(e.oracle_sql()) <= set(e.queries())
assert SparkContext._active_spark_context is None
print("NAMES", *e.queries())
"""


def test_queries_are_named_without_a_session():
    said = subprocess.run([sys.executable, "-B", "-c", _ALL], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr
    names = said.stdout.rpartition("NAMES")[2].split()
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 14))
