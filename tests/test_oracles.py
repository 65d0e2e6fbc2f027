"""Every query with a SQL twin gives the twin's rows on the smallest data."""

import decimal
import math
import os

import pytest

import __spark_entry__ as entry
from sondhan.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings articles sources hybrid_results_labse entity_records entity_matches".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal) or (isinstance(v, int) and not isinstance(v, bool)):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else "NULL" if v is None else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_twin(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cur = duck.execute(registry.ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in r) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLE) <= set(registry.QUERIES)
