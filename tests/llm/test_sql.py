"""The queries that SQL can express, against their SQL."""

import duckdb
import pytest

from barloom.llm import queries

DATA = "/root/testdata/sf0.001"


def plain(df):
    cols = sorted(df.columns)
    text = df[cols].map(lambda v: "" if v is None or v != v else repr(float(v)) if hasattr(v, "__float__") and not isinstance(v, str) else str(v))
    return sorted(map(tuple, text.values.tolist())), cols


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = plain(queries.queries()[name](spark, DATA).toPandas()), plain(con.execute(queries.oracle_sql()[name]).fetchdf())
    assert got == want
