"""Driver contract: entry runs, every query builds, oracle columns match on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.check import norm
from velado.plans import catalog
from velado.plans.registry import TABLES

from .conftest import SF

#: Trained models, and masking of the documents by the look-around rules (their oracle runs on the notes).
ROWS_ONLY = {"protected_mask", "protected_mask_wide", "mask_with_entities", "tagger_train_eval", "tagger_spans_eval",
             "span_classifier_veto"}
ORACLES = sorted(catalog.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "masked" in df.columns


def test_every_query_has_oracle_or_is_rows_only():
    assert set(catalog.queries()) == set(ORACLES) | ROWS_ONLY
    assert set(catalog.queries()) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", ORACLES)
def test_oracle_matches_at_smallest_scale(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    order = sorted(df.columns)
    pos = [ocols.index(c) for c in order]
    a = sorted(tuple(norm(r[c]) for c in order) for r in df.collect())
    b = sorted(tuple(norm(row[i]) for i in pos) for row in res.fetchall())
    assert a == b
