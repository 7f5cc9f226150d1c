import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("kept", [(), ("corpus_pipeline.py",)])
def test_the_rest_works_without_the_training_data_part(tmp_path, kept):
    """A copy without that subpackage, with or without its pipeline's file, still imports and registers its own queries."""
    import shutil

    for name in ("tessera", "__spark_entry__.py", *kept):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and not [k for k in q if k[:2] == 'op' and k[2].isdigit()]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_training_data_part():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tessera.llm" not in p.read_text(), p
