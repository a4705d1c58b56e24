"""Queries of this subpackage against their SQL in DuckDB at the smallest size."""

import duckdb
import pytest

from tidewright.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({ORACLE_SQL[name]})").fetchall()
    assert want and sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*columns).collect())
