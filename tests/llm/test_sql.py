"""Queries that SQL can express, against DuckDB."""

import pytest

from flowframe.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in columns]
    expected = sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == expected
