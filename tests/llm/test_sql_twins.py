import os

import duckdb
import pytest

from panelwright.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return tuple(v) if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, name):
    got = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
