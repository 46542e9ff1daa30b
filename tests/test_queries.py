"""Each registered query of this library against its SQL, on tables large enough that keys repeat."""

import os

import duckdb
import pytest

from quillspan.plans import catalog

SIZES = ["sf0.01"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")


@pytest.fixture(scope="module", params=SIZES)
def tables(request):
    d, c = f"/root/testdata/{request.param}", duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    return d, c


def plain(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, tables, name):
    d, duck = tables
    df = catalog.queries()[name](spark, d)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert plain(got) == plain([tuple(r[k] for k in at) for r in want.fetchall()])
    else:
        assert got
