"""The entry points, and that the library stands without its optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["c", "nation", "region"] and df.count() > 0


def test_names():
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_without_the_optional_subpackage(tmp_path):
    """A copy without the folders and the pipeline's module imports, and has all other queries."""
    for name in ("graphloom", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n[2:3].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_nothing_imports_the_optional_subpackage():
    own = [p for p in (ROOT / "graphloom").rglob("*.py") if "llm" not in p.parts]
    assert own and not any("graphloom.llm" in p.read_text() or "corpus_pipeline" in p.read_text() for p in own)
