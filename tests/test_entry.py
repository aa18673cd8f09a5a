import os

import duckdb
import pytest

import __spark_entry__ as entry_mod
from scripts import check_oracle

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert "pm25_mean" in df.columns


def test_every_query_has_a_callable_and_oracles_are_subset():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert len(q) >= 60
    assert set(o) <= set(q)


@pytest.mark.parametrize("name", ["hourly_mean", "gap_fill", "processed_table", "city_summary", "frequent_itemsets",
                                  "histogram_50", "gaussian_nb", "lof_scores", "station_sensors"])
def test_query_matches_oracle(spark, name):
    if not os.path.exists(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in ["events", "orders", "lineitem"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = entry_mod.queries()[name](spark, SF).toPandas()
    exp = con.execute(entry_mod.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(exp.columns)
    cols = sorted(got.columns)
    a, b = check_oracle.rows_of(got, cols), check_oracle.rows_of(exp, cols)
    assert len(a) == len(b)
    assert all(check_oracle.close(x, y) for x, y in zip(a, b))
