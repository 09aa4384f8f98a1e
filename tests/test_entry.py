"""The entry without the parts that can be left out."""

import os
import shutil
import subprocess
import sys

from commercium.registry import QUERIES
from oracles import ORACLES

WANTED = [str(len(QUERIES)), str(len(ORACLES)), "False"]
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op1_') for n in e.queries()))"


def _run(folder, code):
    env = {**os.environ, "PYTHONPATH": folder}
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=120)


def _copy(tmp_path, *left_out):
    folder = str(tmp_path / "copy")
    ignore = shutil.ignore_patterns(".git", "__pycache__", *left_out)
    shutil.copytree(ROOT, folder, ignore=ignore)
    return folder


def test_entry_stands_without_the_text_operators(tmp_path):
    folder = _copy(tmp_path, "llm", "corpus_pipeline.py")
    out = _run(folder, NAMES)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == WANTED
    assert _run(folder, "import sys; sys.path.insert(0, 'tests'); import test_oracles").returncode == 0


def test_entry_stands_without_the_package_alone(tmp_path):
    folder = _copy(tmp_path, "llm")  # the pipeline file is left behind
    out = _run(folder, NAMES)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == WANTED


def test_entry_stands_without_a_library_of_the_text_operators(tmp_path):
    out = _run(_copy(tmp_path), "import sys; sys.modules['xxhash'] = None; " + NAMES)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == WANTED
