"""Every screening query with SQL gives what DuckDB gives."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from millrace.plans.oracle import ORACLE_SQL
from millrace.plans.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "conversations documents labels benchmark events customer lineitem".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.skipif(not DATA.exists(), reason="test data absent")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(k)] for k in columns) for r in result.fetchall()), key=_key)
    assert sorted((tuple(r[k] for k in columns) for r in frame.collect()), key=_key) == want


@pytest.mark.skipif(not DATA.exists(), reason="test data absent")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_a_missing_library_costs_no_screening_query():
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.screening.QUERIES), len(e.oracle_sql()) > 30)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120).stdout.split() == ["True", "True"]


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
