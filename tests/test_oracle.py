"""Every catalogue key with an oracle must equal its DuckDB twin (sf0.001 by default)."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from screenlens.sources.tables import TABLES
from tools.compare import digest

Q = queries()
O = oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(O) <= set(Q)


@pytest.mark.parametrize("key", sorted(O))
def test_matches_oracle(spark, sf, con, key):
    sdf = Q[key](spark, sf)
    scols, srows = sdf.columns, [tuple(r) for r in sdf.collect()]
    res = con.execute(O[key])
    ocols, orows = [d[0] for d in res.description], res.fetchall()
    assert sorted(scols) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(scols, srows)[0] == digest(ocols, orows)[0]


@pytest.mark.parametrize("key", sorted(set(Q) - set(O)))
def test_rows_only_keys_run(spark, sf, key):
    assert Q[key](spark, sf).count() >= 0


def test_entry(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.count() > 0
    assert "final" not in df.columns and "label" in df.columns
