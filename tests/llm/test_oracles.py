"""The queries that SQL can express give the rows of their SQL."""

import duckdb
import pytest

from pagewright.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = db.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    found = queries.QUERIES[name](spark, DATA)
    assert sorted(found.columns) == sorted(names)
    show = lambda v: f"{v:.12g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(show, r)) for r in found.select(*names).collect()) == sorted(tuple(map(show, r)) for r in want.fetchall())
