"""The driver's contract, with and without the llm subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_keys_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_llm():
    code = "import sys; sys.modules['loomtext.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p5_found' in q and 'p1_found' not in q; print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout) > 50


def test_core_does_not_name_llm():
    for p in (REPO / "loomtext").rglob("*.py"):
        if "llm" not in p.parts:
            assert "loomtext.llm" not in p.read_text(encoding="utf-8"), p


def test_a_broken_dependency_is_no_absence():
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__"
    got = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True)
    assert got.returncode and "regex" in got.stderr or not (REPO / "loomtext/llm").exists()
