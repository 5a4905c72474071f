"""Every registered query against its SQL on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import compare, connect

from evalloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
ENTRIES = catalog.load()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(name, spark, con):
    entry = ENTRIES[name]
    _, _, verdict = compare(con, entry.build(catalog.Tables(spark, FOLDER)), entry.sql)
    assert verdict.startswith(("ok", "rows only")), verdict


def test_catalogue_needs_no_session():
    import subprocess

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    root = Path(__file__).resolve().parents[1]
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
