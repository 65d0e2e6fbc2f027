"""Queries of the subpackage with a SQL twin give the twin's rows on the smallest data."""

import os

import pytest

from sondhan.llm import queries

DATA = "/root/testdata/sf0.001"
TABLES = "articles sources documents hybrid_results_labse entity_records entity_matches".split()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    cur = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in cur.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(cols) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(cur.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query_runs_without_repeats(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and len(set(rows)) == len(rows)
