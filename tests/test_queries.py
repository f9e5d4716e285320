"""Every query of the core library against DuckDB on the smallest tables; without SQL it has to give rows."""

import math

import pytest

from flowframe.queries import ORACLE_SQL, QUERIES


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
