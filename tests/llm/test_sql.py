"""Every query of the training-data operators with SQL gives what DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from millrace.llm.oracle import ORACLE_SQL
from millrace.llm.queries import QUERIES

DATA = Path("/root/testdata/sf0.001")


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.skipif(not DATA.exists(), reason="test data absent")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    frame = QUERIES[name](spark, str(DATA))
    columns = sorted(frame.columns)
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(k)] for k in columns) for r in result.fetchall()), key=_key)
    assert sorted((tuple(r[k] for k in columns) for r in frame.collect()), key=_key) == want
