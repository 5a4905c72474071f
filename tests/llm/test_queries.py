"""Every query against its SQL on the smallest tables, and the catalogue."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT / "tools"))

from check import compare, connect

from evalloom.llm import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, name):
    _, _, verdict = compare(connect(FOLDER), catalog.QUERIES[name](spark, FOLDER), catalog.ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_one_query_per_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.QUERIES if n != "pipeline")
    assert numbers == list(range(1, 14)) and "pipeline" in catalog.QUERIES


def test_entry_without_the_subpackage(tmp_path):
    """The entry module imports, and lists the other queries, when this subpackage and the pipeline are not there."""
    for part in ("__spark_entry__.py", "evalloom"):
        (tmp_path / part).symlink_to(ROOT / part) if part.endswith(".py") else None
    package = tmp_path / "evalloom"
    package.mkdir()
    for part in (ROOT / "evalloom").iterdir():
        if part.name != "llm":
            (package / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n == 'pipeline' or n[:3] in ('op1', 'op2') for n in q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=False, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
