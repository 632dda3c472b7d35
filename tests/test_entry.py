"""Driver contract: entry runs, every query has a callable, oracle keys are a subset."""

import duckdb

import __spark_entry__ as entry_mod
from conftest import SF


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_oracle_keys_are_queries():
    assert set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


def test_some_queries_match_oracle_at_smallest_scale(spark):
    con = duckdb.connect()
    for t in ["events", "conversations"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ["topic_catalog", "commit_batches_20", "grouped_within", "route_conditional"]:
        got = entry_mod.queries()[name](spark, SF).toPandas()
        want = con.sql(entry_mod.oracle_sql()[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        g = got[cols].astype(str).sort_values(cols).reset_index(drop=True)
        w = want[cols].astype(str).sort_values(cols).reset_index(drop=True)
        assert g.equals(w), name
