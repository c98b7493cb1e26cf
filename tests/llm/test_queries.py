"""The queries with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

from tools.check import norm
from velado.llm import queries
from velado.plans.registry import TABLES

from ..conftest import SF


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, res = queries.queries()[name](spark, SF), con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    have = sorted(tuple(norm(r[c]) for c in sorted(names)) for r in df.collect())
    assert have == sorted(tuple(norm(row[names.index(c)]) for c in sorted(names)) for row in res.fetchall())


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
