"""Every registered query of the library runs at the smallest scale; those with SQL equal it."""

import duckdb
import pytest

from orrery.plans.queries import ORACLE_SQL, QUERIES

from .compare import TABLES, norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in ORACLE_SQL:
        rel = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        ix = [names.index(c) for c in cols]
        assert got == sorted(tuple(norm(r[i]) for i in ix) for r in rel.fetchall())
