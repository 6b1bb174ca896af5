"""The library and the driver contract do not need the text operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_works_without_the_text_operators(tmp_path):
    for name in ("fiscus", "testbed"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 65


def test_nothing_outside_imports_the_text_operators():
    for folder in ("fiscus", "testbed"):
        for file in (ROOT / folder).rglob("*.py"):
            if "llm" not in file.relative_to(ROOT).parts:
                assert "fiscus.llm" not in file.read_text(encoding="utf-8"), file
