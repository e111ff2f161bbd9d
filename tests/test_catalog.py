"""Queries of the catalog against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tidebar import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    plain = lambda df: sorted(tuple("" if v != v or v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in (float(x) if not isinstance(x, str) and hasattr(x, "__float__") and not hasattr(x, "year") else x for x in row)) for row in df[cols].itertuples(index=False))
    assert plain(got) == plain(want)


SAMPLE = ["backtest_golden_cross", "backtest_stops", "equity_curve", "trades", "rebalance_monthly", "preset_trendFollowing", "preset_superTrend", "preset_dollarCostAverage", "sweep_golden_cross", "walk_forward_robustness", "journal", "what_if", "leaderboard", "stress", "fractal", "gmm_regimes", "price_forecast", "similar_strategies", "consensus_signals", "bootstrap_bands", "pairs_trading", "factor_fit", "portfolio_weights", "trades_page"]


@pytest.mark.parametrize("name", SAMPLE)
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() >= 0 and df.columns


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 6
    assert set(e.oracle_sql()) <= set(e.queries())
