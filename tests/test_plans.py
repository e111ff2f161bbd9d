"""Plans over series against plain NumPy versions."""

import datetime as dt
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from tidebar.functions import limits
from tidebar.operators import indicators, simulate, steps
from tidebar.operators.simulate import Rules
from tidebar.plans import analytics, metrics, quant, search
from tidebar.sources import feed, report


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(7)
    days = pd.date_range("2020-01-01", periods=700)
    common = rng.normal(0, 0.01, 700)
    values = {s: 100 * np.cumprod(1 + k * common + rng.normal(0.0003, 0.01, 700)) for s, k in (("A", 1.0), ("B", 0.5), ("C", 0.0))}
    df = pd.concat([pd.DataFrame({"symbol": s, "ts": days, "value": v}) for s, v in values.items()])
    spark.createDataFrame(df).createOrReplaceTempView("series")
    return df.pivot(index="ts", columns="symbol", values="value")


def returns(series):
    return series.pct_change().dropna()


def test_split_effect_is_welch(spark, series):
    got = spark.sql(metrics.split_effect("month(ts) = 1")).toPandas().set_index("symbol")
    for s, r in returns(series).items():
        a, b = r[r.index.month == 1], r[r.index.month != 1]
        u, v = a.var() / len(a), b.var() / len(b)
        assert math.isclose(got.t[s], (a.mean() - b.mean()) / math.sqrt(u + v), abs_tol=1e-4)
        assert math.isclose(got.df[s], (u + v) ** 2 / (u * u / (len(a) - 1) + v * v / (len(b) - 1)), abs_tol=0.01)


def test_tails_and_spans(spark, series):
    got, spans = spark.sql(metrics.tail_shape()).toPandas().set_index("symbol"), spark.sql(metrics.period_analysis()).toPandas().set_index(["symbol", "span"])
    for s, r in returns(series).items():
        z = (r - r.mean()) / r.std(ddof=0)
        assert math.isclose(got["skew"][s], (z**3).mean(), abs_tol=2e-5) and math.isclose(got["kurtosis"][s], (z**4).mean() - 3, abs_tol=2e-5)
        assert math.isclose(got.low_mean[s], r[r <= r.quantile(0.05)].mean(), abs_tol=2e-6)
        assert math.isclose(spans.total_return[s, "3M"], series[s].iloc[-1] / series[s].iloc[-64] - 1, abs_tol=2e-6)
        assert spans.bars[s, "ALL"] == len(r)


def test_holidays_and_windows(spark, series):
    got = spark.sql(metrics.holiday_effect(("2020-03-01", "2019-01-01"))).toPandas().set_index(["symbol", "holiday"])
    r = returns(series)
    assert math.isclose(got.before_r["A", pd.Timestamp("2020-03-01")], r.A["2020-02-29"], abs_tol=1e-6)
    assert math.isclose(got.after_r["A", pd.Timestamp("2020-03-01")], r.A["2020-03-02"], abs_tol=1e-6)
    assert pd.isna(got.before_r["A", pd.Timestamp("2019-01-01")])
    span = spark.sql(metrics.window_performance((("w", "2020-02-01", "2020-04-30"),))).toPandas().set_index("symbol")
    v = series.B["2020-02-01":"2020-04-30"]
    assert math.isclose(span.max_drawdown["B"], (v / v.cummax() - 1).min(), abs_tol=1e-6) and span.bars["B"] == len(v)


def binned(x, n):
    return np.minimum(np.floor((x - x.min()) / (x.max() - x.min()) * n), n - 1).astype(int)


def entropy(*cols):
    p = np.unique(np.column_stack(cols), axis=0, return_counts=True)[1] / len(cols[0])
    return -(p * np.log2(p)).sum()


def test_information(spark, series):
    mi, te = spark.sql(quant.mutual_information(8)).toPandas().set_index(["a", "b"]), spark.sql(quant.transfer_entropy(4)).toPandas().set_index(["source", "target"])
    r = returns(series)
    for a, b in combinations("ABC", 2):
        x, y = binned(r[a].to_numpy(), 8), binned(r[b].to_numpy(), 8)
        assert math.isclose(mi.mutual_information[a, b], entropy(x) + entropy(y) - entropy(x, y), abs_tol=2e-5)
        assert math.isclose(mi.conditional_entropy[a, b], entropy(x, y) - entropy(x), abs_tol=2e-5)
        for s, t in ((a, b), (b, a)):
            x0, y1, y0 = (q.to_numpy() if hasattr(q, "to_numpy") else q for q in (binned(r[s].to_numpy(), 4)[:-1], binned(r[t].to_numpy(), 4)[1:], binned(r[t].to_numpy(), 4)[:-1]))
            assert math.isclose(te.transfer_entropy[s, t], entropy(y1, y0) - entropy(y0) - entropy(y1, y0, x0) + entropy(y0, x0), abs_tol=2e-5)


def test_correlation_tests_and_diversification(spark, series):
    r = returns(series)
    got = analytics.correlation_tests(spark.sql(quant.PAIRS)).toPandas().set_index(["a", "b"])
    for a, b in combinations("ABC", 2):
        d = [np.sign(np.subtract.outer(r[k].to_numpy(), r[k].to_numpy())) for k in (a, b)]
        assert math.isclose(got.kendall[a, b], (d[0] * d[1]).sum() / math.sqrt(np.abs(d[0]).sum() * np.abs(d[1]).sum()), rel_tol=1e-9)
        assert math.isclose(got.pearson[a, b], r[a].corr(r[b]), rel_tol=1e-9)
    assert got.pearson_p["A", "B"] < 1e-6
    row = spark.sql(quant.diversification()).first()
    assert math.isclose(row["ratio"], r.std().sum() / math.sqrt(r.cov().to_numpy().sum()), abs_tol=2e-5) and row["effective_n"] == 3


def test_kendall_ties():
    x, y = np.array([1, 1, 2, 2, 3, 3.0]), np.array([1, 2, 1, 2, 2, 2.0])
    d = [np.sign(np.subtract.outer(v, v)) for v in (x, y)]
    assert math.isclose(analytics.kendall_of(x, y), (d[0] * d[1]).sum() / math.sqrt(np.abs(d[0]).sum() * np.abs(d[1]).sum()))
    assert analytics.kendall_of(np.ones(4), x[:4]) == 0.0


@pytest.fixture(scope="module")
def bars(spark, series):
    df = spark.table("series")
    return df.selectExpr("symbol", "ts", "value * 0.999 AS open", "value * (1.001 + 0.002 * pmod(xxhash64(ts), 3)) AS high", "value * (0.999 - 0.002 * pmod(xxhash64(ts, symbol), 3)) AS low", "value AS close", "1000e0 AS volume")


def test_regimes_by_the_documented_rule(bars):
    got = steps.query(quant.market_regimes(), bars=bars).toPandas()
    for symbol, b in bars.toPandas().sort_values("ts").groupby("symbol"):
        c, h, l, mine = b.close.reset_index(drop=True), b.high.to_numpy(), b.low.to_numpy(), got[got.symbol == symbol].sort_values("ts").reset_index(drop=True)
        tr, up, down = np.zeros(len(c)), np.zeros(len(c)), np.zeros(len(c))
        for i in range(1, len(c)):
            tr[i] = max(h[i] - l[i], abs(h[i] - c[i - 1]), abs(l[i] - c[i - 1]))
            u, d = h[i] - h[i - 1], l[i - 1] - l[i]
            up[i], down[i] = (u if u > max(d, 0) else 0), (d if d > max(u, 0) else 0)
        mean = lambda x: pd.Series(x).rolling(14).mean()
        pdi, mdi = 100 * mean(up) / (mean(tr) + 1e-10), 100 * mean(down) / (mean(tr) + 1e-10)
        adx = mean(100 * (pdi - mdi).abs() / (pdi + mdi + 1e-10))
        for i in range(199, len(c), 37):
            m50, m200, now = c[i - 49 : i + 1].mean(), c[i - 199 : i + 1].mean(), c[i]
            trend = np.clip(0.3 * (now / m50 - 1) + 0.3 * (now / m200 - 1) + 0.4 * (m50 / m200 - 1), -1, 1)
            vol = c.pct_change()[i - 19 : i + 1].std() * np.sqrt(252)
            want = "high_volatility" if vol > 0.4 else "strong_uptrend" if trend > 0.15 and adx[i] > 25 else "uptrend" if trend > 0.05 else "strong_downtrend" if trend < -0.15 and adx[i] > 25 else "downtrend" if trend < -0.05 else "sideways"
            row = mine.loc[i - 199]
            assert row.regime == want and abs(row.trend - trend) < 1e-4 and abs(row.volatility - vol) < 1e-4 and abs(row.adx - adx[i]) < 1e-4


def test_journal_takes_excursions_from_the_equity(spark):
    equity = spark.createDataFrame([("T", i, float(v)) for i, v in enumerate((100, 90, 120, 110, 130))], "symbol string, ts int, value double")
    trips = spark.createDataFrame([("T", 1, 0, 2, 5.0, 1.0), ("T", 2, 2, 3, -4.0, -1.0), ("T", 3, 4, 4, 1.0, 1.0)], "symbol string, trade_no int, entry_ts int, exit_ts int, pct double, pnl double")
    got = {r.trade_no: r for r in analytics.journal(trips, equity).collect()}
    assert (got[1].mfe, got[1].mae) == (20.0, -10.0) and abs(got[2].mae + 100 / 12) < 1e-9 and got[2].mfe == 0 and (got[3].mfe, got[3].mae) == (0, 0)
    assert got[1].r == 1.25 and got[1].grade == "C"


def test_forecast_uses_the_whole_series():
    tail = np.linspace(100, 110, 250)
    assert analytics.forecast_of(np.concatenate((np.full(400, 50.0), tail))) != analytics.forecast_of(tail)


def test_queries_leave_the_sessions_views_alone(spark):
    spark.sql("SELECT 1 AS mine").createOrReplaceTempView("bars")
    df = spark.createDataFrame([("T", 1)], "symbol string, ts int")
    assert steps.query("SELECT symbol FROM bars", bars=df).collect()[0].symbol == "T" and spark.table("bars").columns == ["mine"]
    spark.catalog.dropTempView("bars")


def test_regime_forecast_rows_sum_to_one(bars):
    p = steps.query(quant.regime_forecast(3), bars=bars).toPandas()
    one = steps.query(quant.transitions(), bars=bars).toPandas()
    ends = {s for s in one.nxt} <= {s for s in one.regime}
    assert not ends or np.allclose(p.groupby(["symbol", "regime"]).p.sum(), 1, atol=1e-4)
    spells = steps.query(quant.regime_spells(), bars=bars).toPandas()
    assert (spells.mean_bars * spells.spells).sum().round() == steps.query(quant.regimes(), bars=bars).count()


def test_rolling_max_drawdown(spark, series):
    got = analytics.rolling_max_drawdown(spark.table("series"), 30).toPandas().pivot(index="ts", columns="symbol", values="max_drawdown")
    want = series.C.rolling(30, min_periods=2).apply(lambda v: (v / np.maximum.accumulate(v) - 1).min(), raw=True)
    assert np.allclose(got.C, want, equal_nan=True)


def test_frontier(spark, series):
    f = analytics.frontier(spark.table("series"), 20)
    assert np.allclose([sum(w.values()) for w in f.weights], 1) and f.target.is_monotonic_increasing
    r = returns(series)
    mu, cov = r.mean() * 252, r.cov() * 252
    rng = np.random.default_rng(0)
    for w in rng.dirichlet(np.ones(3), 300):  # no portfolio lies left of the frontier
        assert math.sqrt(w @ cov @ w) >= np.interp(w @ mu, f.target, f.volatility) - 2e-3
    assert all(math.isclose(sum(w[k] * mu[k] for k in mu.index), t, rel_tol=1e-6, abs_tol=1e-9) for w, t in zip(f.weights, f.target))


def test_attribution_adds_up(spark, series):
    r = returns(series)
    x = pd.DataFrame({"symbol": "C", "ts": r.index, "r": r.C.to_numpy(), "f": r.A.to_numpy(), "g": r.B.to_numpy()})
    df = spark.createDataFrame(x)
    got = analytics.attribution(df, analytics.factor_fit(df, ["f", "g"]), ["f", "g"]).toPandas()
    assert np.allclose(got.alpha + got.f_part + got.g_part + got.residual, got.r) and abs(got.residual.mean()) < 1e-9


def test_gaussian_paths(spark):
    m = spark.createDataFrame([("A", 0.001, 0.01)], "symbol string, mean double, std double")
    p = search.gaussian(m, 400, 50)
    got = np.log(p.toPandas().final)
    assert abs(got.mean() - 50 * (0.001 - 0.00005)) < 0.015 and abs(got.std() - 0.01 * math.sqrt(50)) < 0.01
    risk = search.simulated_risk(p).first()
    assert risk["cvar"] <= risk["var"] < 0


def bars_of(series):
    df = series.reset_index().melt("ts", var_name="symbol", value_name="close")
    return df.assign(open=df.close, high=df.close, low=df.close, volume=1e5)


def test_shared_purse(spark, series):
    b = bars_of(series)
    b = b[~((b.symbol == "C") & (b.ts > "2020-06-01"))]  # one symbol's bars end
    signalled = steps.apply(spark.createDataFrame(b), indicators.golden_cross())
    free = simulate.shared(signalled, Rules(cash=1e6, commission=0, tax=0, slippage=0)).toPandas().sort_values("ts")
    paid = simulate.shared(signalled, Rules(cash=1e6)).toPandas()
    assert (paid.cash >= 0).all() and paid.positions.max() >= 2
    assert free.equity.iloc[0] == 1e6 and len(free) == b.ts.nunique()
    # without costs, equity moves only by what is held
    assert (free.equity[free.positions == 0].diff().dropna().abs() < 1e6).all() and (free.equity > 0).all()


def test_timed_signals():
    assert simulate.timed(np.array([0, 1, 1, 0, 0, 1, -1, 1]), 2).tolist() == [0, 1, 0, -1, 0, 1, -1, 1]


def test_signal_backtest(spark, series):
    got = simulate.signal_backtest(steps.apply(spark.createDataFrame(bars_of(series)), indicators.golden_cross())).toPandas()
    assert len(got) == 3 and (got.max_drawdown >= 0).all() and got.better_than_random.between(0, 1).all()


def test_trend_filter(spark):
    df = pd.DataFrame({"symbol": "T", "ts": pd.date_range("2024-01-01", periods=4), "close": [1.0, 2, 1, 3], "signal": [1, 1, -1, 1], "adx": [30.0, 30, 30, 10]})
    got = steps.apply(spark.createDataFrame(df), indicators.trend_filter(n=2)).orderBy("ts").toPandas().filtered.tolist()
    assert got == [0, 1, -1, 0]


def test_limits(spark):
    base = {"side": "BUY", "value": 10.0, "equity": 100.0, "peak": 100.0, "day_start": 100.0, "held": 0.0, "own": 0.0, "open_positions": 0, "nth": 1}
    rows = [base, base | {"peak": 200.0}, base | {"day_start": 110.0}, base | {"nth": 51}, base | {"value": 30.0}, base | {"own": 15.0}, base | {"held": 95.0}, base | {"open_positions": 10}, base | {"side": "SELL", "value": 99.0}]
    got = [r[0] for r in spark.createDataFrame(pd.DataFrame(rows)).selectExpr(limits.verdict()).collect()]
    assert got == ["ok", "drawdown", "day_loss", "orders", "position", "position", "exposure", "positions", "ok"]
    assert "0.25" in limits.verdict(limits.PRESETS["aggressive"])


def test_paged_feed(spark):
    spark.dataSource.register(feed.PagedFeed)
    df = spark.read.format("bar_pages").option("fetch", "tidebar.sources.feed:sample").option("symbol", "S").option("start", "2024-01-01").option("end", "2024-03-31").option("days", 30).load()
    assert df.rdd.getNumPartitions() == 4
    assert df.count() == 91 and df.where("high < low").count() == 0 and df.agg({"ts": "max"}).first()[0] == dt.datetime(2024, 3, 31)


def test_rolling_factors_and_risk(spark, series):
    r = returns(series)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "C", "ts": r.index, "r": r.C.to_numpy(), "f": r.A.to_numpy(), "g": r.B.to_numpy()}))
    got = analytics.rolling_factors(df, ["f", "g"], 60).toPandas().set_index("ts")
    assert len(got) == len(r) - 59
    x = np.column_stack([np.ones(60), r.A[100:160], r.B[100:160]])
    assert np.allclose(got.loc[r.index[159], ["alpha", "f", "g"]].astype(float), np.linalg.lstsq(x, r.C[100:160], rcond=None)[0], atol=1e-8)
    risk = analytics.factor_risk(df, analytics.factor_fit(df, ["f", "g"]), ["f", "g"]).first()
    assert math.isclose(risk["f_risk"] + risk["g_risk"] + risk["specific"], risk["total"], rel_tol=1e-6)


def test_choice_and_clusters(spark):
    corr = spark.createDataFrame([("A", "B", 0.9), ("A", "C", 0.1), ("A", "D", 0.0), ("B", "C", 0.2), ("B", "D", 0.3), ("C", "D", 0.95)], "a string, b string, corr double")
    assert analytics.low_correlation(corr, 2) == ["A", "D"] and len(analytics.low_correlation(corr, 9)) == 4
    got = analytics.clusters(corr, 2).set_index("symbol").cluster
    assert got["A"] == got["B"] != got["C"] == got["D"]


def test_buckets_votes_and_advice(spark):
    days = pd.date_range("2024-01-01", periods=12)
    v = pd.DataFrame({"symbol": "T", "ts": days, "close": np.arange(1.0, 13), "signal": [1, -1] + [0] * 10, "strength": [1.0, 0.4] + [0.0] * 10})
    got = analytics.strength_buckets(spark.createDataFrame(v)).toPandas().set_index("bucket")
    assert got.accuracy["0.8-1"] == 1 and got.accuracy["0.4-0.5"] == 0
    s = spark.createDataFrame([("T", 1, k, x) for k, x in (("a", 1), ("b", 1), ("c", -1))], "symbol string, ts int, strategy string, signal int")
    assert analytics.voted(s).first()["signal"] == 1 and analytics.voted(s, 0.7).first()["signal"] == 0
    regimes = spark.createDataFrame([("T", 1, "sideways", 10.0), ("T", 2, "strong_uptrend", 35.0)], "symbol string, ts int, regime string, adx double")
    got = analytics.advice(regimes).orderBy("rank").collect()
    assert [r["strategy"] for r in got] == ["MACD", "SMA Cross", "Breakout"] and math.isclose(got[0]["score"], 0.3 + 0.475 + 0.1 + 0.05)


def test_combined(spark, series):
    c = spark.createDataFrame(series.reset_index().melt("ts", var_name="strategy", value_name="value").assign(symbol="T"))
    got = analytics.combined(c).orderBy("ts").toPandas()
    r = returns(series).mean(axis=1)
    assert np.allclose(got.r, r) and np.allclose(got.growth, np.cumprod(1 + r))
    assert np.allclose(analytics.combined(c.where("strategy = 'A'"), "sharpe").orderBy("ts").toPandas().r, returns(series).A)


def test_report(spark, series):
    page = report.html("A & B", spark.table("series"), {"spans": spark.sql(metrics.period_analysis())})
    assert "A &amp; B" in page and page.count("<svg") == 3 and "total_return" in page
    assert report.thinned(spark.table("series"), 50).groupBy("symbol").count().agg({"count": "max"}).first()[0] <= 50
