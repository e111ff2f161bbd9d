"""Recurrences, simulation, sources, streaming and helpers against plain versions and golden values."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.functions import stats, text
from tidebar.operators import indicators, recurrences, simulate, steps
from tidebar.operators.simulate import Rules
from tidebar.plans import analytics, presets, search
from tidebar.sources import bars as sources
from tidebar.streaming import bars as streaming


def frame(close, symbol="T", high=None, low=None, open_=None, volume=None):
    n = len(close)
    c = np.array(close, float)
    return pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2024-01-01", periods=n), "open": c if open_ is None else open_, "high": c if high is None else high, "low": c if low is None else low, "close": c, "volume": np.full(n, 1e5) if volume is None else volume})


@pytest.fixture(scope="module")
def walk():
    rng = np.random.RandomState(42)
    c = 100 * np.cumprod(1 + rng.normal(0.0005, 0.02, 300))
    return frame(c, high=c * (1 + np.abs(rng.normal(0, 0.01, 300))), low=c * (1 - np.abs(rng.normal(0, 0.01, 300))), volume=rng.randint(1e5, 1e6, 300).astype(float))


def test_cross_golden(spark):
    df = pd.DataFrame({"symbol": "T", "ts": pd.date_range("2024-01-01", periods=7), "f": [1.0, 2, 3, 4, 5, 4, 3], "s": [3.0] * 7})
    got = steps.apply(spark.createDataFrame(df), steps.Spec(({"signal": indicators.cross("f", "s")},), ("signal",))).orderBy("ts").toPandas().signal.tolist()
    assert got == [0, 0, 0, 1, 0, 0, 0]
    assert simulate.crossed(df.f.to_numpy(), df.s.to_numpy()).tolist() == got


def test_sma_head_and_short_input(spark, walk):
    got = steps.apply(spark.createDataFrame(walk), indicators.sma(20)).orderBy("ts").toPandas().sma
    assert got[:19].isna().all() and math.isclose(got[19], walk.close[:20].mean(), rel_tol=1e-10)
    assert steps.apply(spark.createDataFrame(walk[:5]), indicators.sma(20)).toPandas().sma.isna().all()


def test_flat_prices(spark):
    flat = spark.createDataFrame(frame([10.0] * 40, volume=np.zeros(40)))
    for f in indicators.INDICATORS.values():
        assert steps.apply(flat, f()).count() == 40  # no division error
    assert recurrences.apply(flat, list(recurrences.RECURRENCES)).count() == 40


def test_recurrences_against_plain_loops(walk):
    c = walk.close.to_numpy()
    e = c[0]
    out = [e]
    for x in c[1:]:
        e += 2 / 21 * (x - e)
        out.append(e)
    assert np.allclose(recurrences.ema(walk)["ema"][19:], out[19:])
    assert math.isclose(recurrences.vema(walk)["vema"][19], c[:20].mean(), rel_tol=1e-10)
    for name, lo, hi in (("rsi_wilder", 0, 100), ("adx", 0, 100), ("adx_wilder", 0, 100)):
        v = recurrences.RECURRENCES[name](walk)[name]
        v = v[~np.isnan(v)]
        assert len(v) and v.min() >= lo and v.max() <= hi
    for f in recurrences.RECURRENCES.values():
        for n in (0, 1, 3):
            f(walk[:n].reset_index(drop=True)) if n else None


def plain_backtest(c, sig, r):
    cash, shares, entry, eq = r.cash, 0, 0.0, []
    for x, s in zip(c, sig):
        if shares and r.stop and (x / entry - 1) * 100 <= -r.stop or shares and r.take and (x / entry - 1) * 100 >= r.take:
            cash += shares * x * (1 - r.slippage) * (1 - r.commission - r.tax)
            shares = 0
        if s == -1 and shares:
            cash += shares * x * (1 - r.slippage) * (1 - r.commission - r.tax)
            shares = 0
        elif s == 1 and not shares:
            q = int(cash * r.invest / (x * (1 + r.slippage)))
            if q and q * x * (1 + r.slippage) * (1 + r.commission) <= cash:
                cash, shares, entry = cash - q * x * (1 + r.slippage) * (1 + r.commission), q, x * (1 + r.slippage)
        eq.append(cash + shares * x)
    return np.array(eq)


@pytest.mark.parametrize("rules", [Rules(), Rules(stop=2, take=3), Rules(cash=500.0)])
def test_simulation_is_the_plain_fold(walk, rules):
    sig = simulate.golden_cross(walk, 3, 8)
    m, (eq, trades) = simulate.lanes(walk, np.stack([sig, sig], 1), rules, keep=True)
    want = plain_backtest(walk.close, sig, rules)
    assert np.allclose(eq[:, 0], want) and np.allclose(eq[:, 1], want)
    r = np.diff(want) / want[:-1]
    assert math.isclose(m["total_return"][0], (want[-1] / rules.cash - 1) * 100, abs_tol=1e-9)
    assert math.isclose(m["volatility"][0], r.std() * math.sqrt(252) * 100, rel_tol=1e-6)
    annual = (want[-1] / rules.cash) ** (252 / len(want)) - 1
    if (r < 0).sum() > 1:
        assert math.isclose(m["sortino"][0], (annual - 0.035) / (r[r < 0].std(ddof=1) * math.sqrt(252)), rel_tol=1e-6)
        assert math.isclose(m["calmar"][0], annual / -(want / np.maximum.accumulate(want) - 1).min(), rel_tol=1e-6)
    assert math.isclose(m["max_drawdown"][0], (want / np.maximum.accumulate(want) - 1).min() * 100, abs_tol=1e-9)


def test_last_bar_signal_never_fills_on_next_open(walk):
    b = walk[:10].reset_index(drop=True)
    sig = np.zeros((10, 1), np.int8)
    sig[9] = 1
    m, _ = simulate.lanes(b, sig, Rules(fill="open"))
    assert m["total_trades"][0] == 0


def test_sweep_equals_single_runs(spark, walk):
    bars = spark.createDataFrame(walk)
    g = search.grid(spark, {"fast": [3, 5], "slow": [8, 12]})
    got = simulate.sweep(bars, g, "goldenCross", block=3).toPandas().set_index("run_id")
    for i, (f, s) in enumerate(((3, 8), (3, 12), (5, 8), (5, 12))):
        one = simulate.backtest(bars, "goldenCross", fast=f, slow=s).toPandas().iloc[0]
        assert math.isclose(got.loc[i].final_equity, one.final_equity)


def test_presets_all_run_on_a_random_walk(spark, walk):
    bars = spark.createDataFrame(walk)
    for p in ("goldenCross", "macdCross", "keltnerChannel", "buyAndHold", "슈퍼트렌드"):
        assert presets.run(bars, p).count() == 1
    assert presets.run(bars, "buyAndHold").first().total_trades == 1


def test_rule_builder(spark, walk):
    df = steps.apply(spark.createDataFrame(walk), indicators.rsi_sma())
    sig = presets.quick(df).buy_when(F.col("rsi") < 40).sell_when(F.col("rsi") > 60).stop_loss(5).signals().toPandas()
    assert set(sig.signal) <= {-1, 0, 1} and (sig.signal[sig.rsi.isna()] == 0).all()


def test_cache_upsert_keeps_the_newer(spark, walk, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    cache = sources.Cache(spark, str(tmp_path / "cache"))
    a = spark.createDataFrame(walk[:10])
    cache.save(a)
    cache.save(spark.createDataFrame(walk[5:12].assign(close=1.0, high=1.0, low=1.0, open=1.0)))
    got = cache.get("T").orderBy("ts").toPandas()
    assert len(got) == 12 and (got.close[5:] == 1.0).all() and got.close[0] == walk.close[0]
    assert cache.info().first().n == 12 and cache.stale(1).count() == 0
    assert cache.complete("2024-01-01", "2024-01-12").first().complete


def test_conform_and_align(spark):
    df = sources.conform(spark.createDataFrame(pd.DataFrame({"Date": pd.date_range("2024-01-01", periods=3), "Close": [1.0, float("nan"), 3.0]})), "X")
    assert df.count() == 2 and df.first().open == 1.0
    two = spark.createDataFrame(pd.concat([frame([1.0, 2, 3], "A"), frame([5.0, 6, 7], "B")[1:]]))
    assert sources.align(two, "inner", "drop").count() == 4
    assert sources.align(two, "outer", "zero").count() == 6
    assert sources.align(two, "left", "ffill", "B").count() == 4


def test_stream_and_batch_bars_agree(spark, tmp_path):
    rows = [("A", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), float(i % 7), 1.0, i) for i in range(100)]
    ticks = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "price", "volume", "seq"]))
    ticks.coalesce(1).write.parquet(str(tmp_path / "t"))
    batch = {tuple(r) for r in streaming.bars(spark.read.parquet(str(tmp_path / "t"))).collect()}
    q = streaming.bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t"))).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    live = {tuple(r) for r in spark.table("live").collect()}
    q.stop()
    assert live and live <= batch and len(batch) - len(live) <= 2  # the last windows are still open
    b = spark.createDataFrame(sorted(batch), "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    b.coalesce(1).write.parquet(str(tmp_path / "b"))
    q = streaming.indicators(spark.readStream.schema(b.schema).parquet(str(tmp_path / "b"))).writeStream.format("memory").queryName("ind").outputMode("append").start()
    q.processAllAvailable()
    got = spark.table("ind").orderBy("ts").toPandas()
    q.stop()
    assert np.allclose(got.fast, pd.Series(got.close).ewm(span=12, adjust=False).mean())


def test_text_helpers():
    assert text.cash("1000만원") == 10_000_000 and text.cash("1억") == 1e8 and text.cash("천만") == 1e7
    assert text.period("30일", dt.date(2024, 1, 31)) == ("2024-01-01", "2024-01-31")
    assert text.symbol("삼성전자") == "005930"


def test_distributions():
    assert math.isclose(stats.t_p(2.0, 10), 0.07338803, rel_tol=1e-5)
    assert math.isclose(stats.f_p(3.0, 2, 20), 0.07252815, rel_tol=1e-3)
    assert stats.t_p(0.0, 5) == 1.0


def test_folds():
    f = search.folds(dt.date(2020, 1, 1), dt.date(2021, 7, 1), 12, 3)
    assert [x[3:] for x in f] == [(dt.date(2021, 1, 1), dt.date(2021, 4, 1)), (dt.date(2021, 4, 1), dt.date(2021, 7, 1))]
    assert search.float_range(0.1, 0.3, 0.1) == [0.1, 0.2, 0.3]


def test_weights():
    mean, cov = np.array([0.1, 0.2, 0.05]), np.diag([0.04, 0.09, 0.01])
    for goal in ("equal", "min_vol", "sharpe", "risk_parity", "mean_variance"):
        w = analytics.optimal_weights(mean, cov, goal)
        assert math.isclose(w.sum(), 1, abs_tol=1e-6) and (w >= -1e-9).all()
    inverse = 1 / np.diag(cov)
    assert np.allclose(analytics.optimal_weights(mean, cov, "min_vol"), inverse / inverse.sum(), atol=1e-3)
