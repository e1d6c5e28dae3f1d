"""Registered queries against their SQL, and the entry without this part."""

import subprocess
import sys
from pathlib import Path

import pytest

from tallyfield.llm import registered
from tests.compare import database, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", list(registered.SQL))
def test_same_as_sql(spark, con, name):
    assert difference(registered.QUERIES[name](spark, SF), con, registered.SQL[name]) is None


def test_entry_without_this_part(tmp_path):
    """A copy of the repository without the folders and the pipeline still imports."""
    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tallyfield.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
assert "q1" in e.queries() and not any(n.startswith("op") for n in e.queries())
assert e.queries().keys() == e.oracle_sql().keys()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)


def test_nothing_else_imports_this_part():
    root = Path(__file__).resolve().parents[2]
    for path in (root / "tallyfield").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tallyfield.llm" not in path.read_text(), path
