"""The core works where the subpackage of training-data operators is not there."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'p6_found' in q; print(len(q))"


def listed(root):
    out = subprocess.run([sys.executable, "-c", LIST], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return int(out.stdout)


def test_entry_without_the_subpackage(tmp_path):
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(ROOT, "vaultlens"), tmp_path / "vaultlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    assert listed(str(tmp_path)) >= 70


def test_nothing_imports_the_subpackage():
    for at, _, names in os.walk(os.path.join(ROOT, "vaultlens")):
        for n in names:
            if n.endswith(".py") and os.path.basename(at) != "llm":
                assert "vaultlens.llm" not in open(os.path.join(at, n), encoding="utf-8").read(), n
