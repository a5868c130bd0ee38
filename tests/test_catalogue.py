"""Every registered query of the engine against DuckDB, and the engine without the training-data folders."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare, connect

from latticework.plans import catalogue

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    if sql := catalogue.oracle_sql().get(name):
        problem, _ = compare(df, duck, sql)
        assert not problem
    else:
        assert df.count() >= 0


def test_without_training_data_folders(tmp_path):
    for item in ("latticework", "__spark_entry__.py"):
        src = ROOT / item
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / item)
    shutil.rmtree(tmp_path / "latticework" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'panel_coverage' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_training_data():
    for path in (ROOT / "latticework").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(import|from)\b.*\bllm\b", path.read_text())
