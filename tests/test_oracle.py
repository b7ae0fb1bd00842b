"""Every query with SQL gives the rows that SQL gives."""

import duckdb
import pytest

from barloom.plans import catalog

DATA = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
#: One of each kind; the others are compared by the driver at sf0.01.
NAMES = ["names_read", "triaged", "warning_classes", "edges", "bars_as_of", "feat_slopes", "label_tail_blocks", "feat_volatility_blocks", "execution_costs", "path_exits", "trades_checked", "flagship", "bars_7min", "feat_volatility", "feat_risk_proxy", "feat_oscillators", "feat_regime", "label_directional", "label_path_extremes", "label_triple_barrier", "audit", "modal", "dataset_rows", "trade_metrics", "stressed", "upsert_bars", "windows"]


def plain(df):
    cols = sorted(df.columns)
    text = df[cols].map(lambda v: "" if v is None or v != v else repr(float(v)) if hasattr(v, "__float__") and not isinstance(v, str) else str(v))
    return sorted(map(tuple, text.values.tolist())), cols


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "nation"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = plain(catalog.queries()[name](spark, DATA).toPandas()), plain(con.execute(SQL[name]).fetchdf())
    assert got[1] == want[1]
    assert got[0] == want[0]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(catalog.queries())
