"""The driver contract."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", ["llm", "xxhash"])
def test_without_llm(tmp_path, gone):
    """The rest imports without the corpus subpackage and its pipeline, or without a package that only they need."""
    shutil.copytree(ROOT / "scriptorium", tmp_path / "scriptorium", ignore=shutil.ignore_patterns("__pycache__", "llm" if gone == "llm" else ""))
    for p in ["__spark_entry__.py"] + (["corpus_pipeline.py"] if gone != "llm" else []):
        if (ROOT / p).exists():  # they may all be taken out
            shutil.copy(ROOT / p, tmp_path / p)
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); sys.modules['xxhash'] = None if {gone == 'xxhash'} else sys; import __spark_entry__ as e; print(sorted(e.queries())[0], any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, timeout=100)
    assert out.stdout.split()[-1] == "False", out.stderr
