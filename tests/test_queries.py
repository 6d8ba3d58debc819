"""A sample of registered queries against their SQL at the smallest scale; the tool runs them all."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import check_oracles as K  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["dedup_by_date", "asof_price", "macd", "adx", "clean_outliers", "sales_window_stats", "velocity_zscore", "screener", "top_movers", "backtest_fees", "exit_signals", "pit_signals", "dedup_sales", "stream_viable_flag"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in K.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    text, _, _, ok = K.compare(spark, con, name, SF)
    assert ok, text


def test_every_oracle_names_a_query():
    assert set(K.entry.oracle_sql()) <= set(K.entry.queries())


def test_entry_has_rows(spark):
    assert K.entry.entry(spark).limit(1).count() == 1
