"""Every registered query with SQL gives what DuckDB gives."""

import math

import duckdb
import pytest

from folio.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted([tuple(plain(r[i]) for i in order) for r in found], key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    wanted = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(wanted.columns, wanted.fetchall())
