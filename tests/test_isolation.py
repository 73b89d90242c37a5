"""The library stands alone: without the training-data folders every other query is still there."""

import os
import shutil
import subprocess
import sys

from wellspring.plans.registry import load_all

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_library_does_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json"))
    code = ("import pkgutil, importlib, wellspring, __spark_entry__ as E\n"
            "[importlib.import_module(m.name) for m in pkgutil.walk_packages(wellspring.__path__, 'wellspring.')]\n"
            "assert set(E.queries()) == set(E.oracle_sql())\nprint(*sorted(E.queries()))")
    got = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": str(copy)})
    assert got.returncode == 0, got.stderr
    assert got.stdout.split() == sorted(load_all())
