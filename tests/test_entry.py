"""The entry module with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("left", ["nothing", "empty folder", "package without queries"])
def test_entry_without_the_subpackage(tmp_path, left):
    shutil.copytree(os.path.join(ROOT, "plotline"), tmp_path / "plotline", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if left != "nothing":
        (tmp_path / "llm").mkdir()
    if left == "package without queries":
        (tmp_path / "llm" / "__init__.py").write_text("")
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True).stdout.split()
    assert int(out[0]) > 100 and out[1:] == ["False", "True"]
