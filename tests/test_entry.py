"""The entry points, with the training-data operators and without them."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e, leafquarry; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sorted(set(o) - set(q)), 'pipeline' in q, any(n.startswith('op1_') for n in q), e.__file__, leafquarry.__file__)"


def shown(folder):
    """What the entry points in the folder show, with no other copy of them on the path."""
    out = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    *shown, entry, package = out.stdout.split()
    assert all(os.path.realpath(x).startswith(os.path.realpath(folder) + os.sep) for x in (entry, package))
    return shown


@pytest.mark.parametrize("gone", [("leafquarry/llm", "tests/llm"), ("leafquarry/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_without_the_training_data_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(TOP, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for g in gone:
        path = copy / g
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() or not path.suffix else path.unlink(missing_ok=True)
    n, _, extra, pipeline, one = shown(copy)
    assert int(n) >= 37 and extra == "[]" and pipeline == "False"
    assert one == str("leafquarry/llm" not in gone and os.path.isdir(os.path.join(TOP, "leafquarry", "llm")))
