"""The driver's contract, also where the training-data operators are gone."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_sql_fit_together(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["level", "type", "is_heading", "is_bullet", "n", "n_ambiguous"]


def test_the_rest_imports_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "quire"):
        source = os.path.join(ROOT, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e, pkgutil, importlib, quire\nfor m in pkgutil.walk_packages(quire.__path__, 'quire.'): importlib.import_module(m.name)\nprint(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.strip() == "79 []", said.stderr


def test_nothing_outside_imports_them():
    for folder, _, files in os.walk(os.path.join(ROOT, "quire")):
        for f in files:
            if f.endswith(".py") and f"{os.sep}llm" not in folder:
                assert "quire.llm" not in open(os.path.join(folder, f)).read(), f
