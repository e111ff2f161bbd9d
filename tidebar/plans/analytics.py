"""Analyses of trades, equity and strategies as tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions import stats
from tidebar.operators import steps

#: Equity and trade frames: equity (symbol, ts, value); round trips (symbol, trade_no, entry_ts, exit_ts, entry_price, exit_price, quantity, pnl, pct).


def round_trips(trades: DataFrame) -> DataFrame:
    """Round trips of a trace's trades: each sale with the purchase before it."""
    w = Window.partitionBy("symbol").orderBy("ts", F.col("side").desc())
    t = trades.withColumn("entry_ts", F.lag("ts").over(w)).withColumn("entry_price", F.lag("price").over(w)).where("side = 'SELL'")
    no = F.row_number().over(Window.partitionBy("symbol").orderBy("ts", "entry_ts"))
    return t.select("symbol", no.alias("trade_no"), "entry_ts", F.col("ts").alias("exit_ts"), "entry_price", F.col("price").alias("exit_price"), "quantity", "pnl", (F.col("pnl") / (F.col("entry_price") * F.col("quantity")) * 100).alias("pct"), F.datediff("ts", "entry_ts").alias("days"))


def journal(trips: DataFrame, equity: DataFrame) -> DataFrame:
    """Excursions of the equity (symbol, ts, value) while each trade was open, against its value at entry, in percent (an
    interval join within the symbol; 0 where fewer than two values lie in it), R multiple and grade."""
    b = equity.select(F.col("symbol").alias("s"), "ts", "value")
    inside = trips.join(b, (F.col("symbol") == F.col("s")) & F.col("ts").between(F.col("entry_ts"), F.col("exit_ts")), "left")
    j = inside.groupBy("symbol", "trade_no").agg(F.first("pct").alias("pct"), F.first("pnl").alias("pnl"), F.count("value").alias("n"), F.min_by("value", "ts").alias("paid"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    risk = F.avg(F.when(F.col("pct") <= 0, F.abs("pct"))).over(Window.partitionBy("symbol"))
    moved = lambda c: F.when((F.col("n") >= 2) & (F.col("paid") != 0), (F.col(c) - F.col("paid")) / F.col("paid") * 100).otherwise(0.0)
    j = j.withColumn("mfe", F.greatest(moved("hi"), F.lit(0.0))).withColumn("mae", F.least(moved("lo"), F.lit(0.0))).withColumn("r", F.col("pct") / F.nullif(risk, F.lit(0.0)))
    grade = F.when(F.col("r") > 3, "A").when(F.col("r") > 2, "B").when(F.col("r") > 1, "C").when(F.col("r") > 0, "D").otherwise("F")
    return j.select("symbol", "trade_no", "pct", "pnl", "mfe", "mae", "r", grade.alias("grade"), (F.col("pct") / F.nullif(F.col("mfe"), F.lit(0.0))).alias("capture"))


def trades_page(trips: DataFrame, kind: str = "all", search: str = "", sort: str = "trade_no", descending: bool = False, page: int = 0, size: int = 20) -> DataFrame:
    """Filter (all, winners, losers), search, sort and page of trades, as a screen shows them."""
    t = trips if kind == "all" else trips.where(F.col("pnl") > 0 if kind == "winners" else F.col("pnl") < 0)
    if search:
        t = t.where(F.lower(F.concat_ws(" ", "symbol", F.col("entry_ts").cast("string"), F.col("exit_ts").cast("string"), F.col("trade_no").cast("string"))).contains(search.lower()))
    key = F.col(sort)
    return t.orderBy(key.desc() if descending else key, "symbol", "trade_no").offset(page * size).limit(size)


def what_if(trips: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Trades priced again under scenarios (name, commission, slippage, tax): both sides pay the first two, the exit the tax. Scenarios are broadcast: a bounded list."""
    entry, exit_ = F.col("entry_price") * F.col("quantity"), F.col("exit_price") * F.col("quantity")
    cost = (entry + exit_) * (F.col("commission") + F.col("slippage")) + exit_ * F.col("tax")
    j = trips.crossJoin(F.broadcast(scenarios)).withColumn("net", exit_ - entry - cost)
    return j.groupBy("symbol", "name").agg(F.sum("net").alias("net"), F.sum(cost).alias("cost"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"))


def leaderboard(results: DataFrame, weights: tuple[float, ...] = (0.3, 0.2, 0.2, 0.15, 0.15)) -> DataFrame:
    """Composite of min-max scaled Sharpe, return, drawdown (shallower is better), win rate and profit factor; rank and badges."""
    w = Window.partitionBy()
    cols = ("sharpe", "total_return", "max_drawdown", "win_rate", "profit_factor")

    def scaled(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi == lo, 50.0).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100)

    r = results.fillna(0.0, subset=["profit_factor"])
    score = sum(k * scaled(c) for k, c in zip(weights, cols))
    r = r.withColumn("score", score)
    badges = F.array_compact(F.array(F.when(F.col("sharpe") > 2, "sharp"), F.when(F.col("max_drawdown") > -10, "steady"), F.when(F.col("win_rate") > 60, "marksman"), F.when(F.col("profit_factor") > 2, "profitable"), F.when(F.col("total_return") > 50, "rocket")))
    return r.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "symbol"))).withColumn("badges", badges)


def dashboard_rank(results: DataFrame) -> DataFrame:
    c = F.round(25 * F.col("sharpe") + 0.5 * F.col("total_return") + 0.3 * F.col("win_rate") + 5 * F.coalesce("profit_factor", F.lit(0.0)) - 0.5 * F.abs("max_drawdown"), 2)
    return results.withColumn("composite", c).withColumn("rank", F.row_number().over(Window.orderBy(F.col("composite").desc(), "symbol")))


def anova(moments: pd.DataFrame) -> tuple[float, float]:
    """F and p-value from group counts, means and variances (a small table)."""
    n, m, v = (moments[c].to_numpy(float) for c in ("n", "mean", "var"))
    k, total = len(n), n.sum()
    if k < 2 or total <= k:
        return 0.0, 1.0
    between = (n * (m - (n * m).sum() / total) ** 2).sum() / (k - 1)
    within = ((n - 1) * np.nan_to_num(v)).sum() / (total - k)
    f = between / within if within else 0.0
    return f, stats.f_p(f, k - 1, total - k)


def per_symbol(series: DataFrame, f, schema: str) -> DataFrame:
    """f(values) -> dict, for each symbol's ordered values."""

    def run(pdf):
        out = f(pdf.sort_values("ts").value.to_numpy(float))
        return pd.DataFrame({"symbol": pdf.symbol.iloc[:1], **{k: [v] for k, v in out.items()}})

    return series.groupBy("symbol").applyInPandas(run, f"symbol string, {schema}")


def hurst_of(values: np.ndarray) -> dict:
    """Rescaled-range and detrended-fluctuation exponents, fractal dimension."""
    r = np.diff(np.log(values[values > 0]))

    def slope(pairs):
        if len(pairs) < 3:
            return 0.5
        x, y = np.log(np.array(pairs)).T
        return float(np.clip(np.polyfit(x, y, 1)[0], 0, 1))

    rs, dfa, n = [], [], 10
    while n <= len(r) // 2:
        blocks = r[: len(r) // n * n].reshape(-1, n)
        dev = np.cumsum(blocks - blocks.mean(axis=1, keepdims=True), axis=1)
        s = blocks.std(axis=1)
        ok = s > 0
        if ok.any():
            rs.append((n, float(((dev.max(axis=1) - dev.min(axis=1))[ok] / s[ok]).mean())))
        walk = np.cumsum(r - r.mean())[: len(r) // n * n].reshape(-1, n)
        t = np.arange(n)
        fit = np.polyfit(t, walk.T, 1)
        dfa.append((n, float(np.sqrt(((walk.T - np.outer(t, fit[0]) - fit[1]) ** 2).mean()) or 1e-12)))
        n = max(n + 1, int(n * 1.5))
    h = slope(rs)
    return {"hurst": h, "dfa": slope(dfa), "dimension": 2 - h}


def gmm_of(values: np.ndarray, k: int = 3, rounds: int = 60) -> dict:
    """Three Gaussian regimes of (return, 20-day volatility) by EM from quantile starts; shares by mean return: bear, sideways, bull."""
    r = pd.Series(values).pct_change()
    x = pd.concat([r, r.rolling(20).std()], axis=1).dropna().to_numpy()
    if len(x) < 60:
        return {"bear": 0.0, "sideways": 1.0, "bull": 0.0, "persistence": 1.0}
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    mu = x[np.argsort(x[:, 0])[[len(x) // 6, len(x) // 2, 5 * len(x) // 6]]]
    var, w = np.ones((k, 2)), np.full(k, 1 / k)
    for _ in range(rounds):
        logp = np.log(w) - 0.5 * (((x[:, None] - mu) ** 2 / var).sum(2) + np.log(var).sum(1))
        p = np.exp(logp - logp.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        n = p.sum(0) + 1e-9
        mu = (p.T @ x) / n[:, None]
        var = np.maximum((p.T @ x**2) / n[:, None] - mu**2, 1e-6)
        w = n / n.sum()
    label = np.argsort(np.argsort(mu[:, 0]))[p.argmax(1)]
    return {"bear": float((label == 0).mean()), "sideways": float((label == 1).mean()), "bull": float((label == 2).mean()), "persistence": float((label[1:] == label[:-1]).mean())}


def forecast_of(values: np.ndarray, horizon: int = 5) -> dict:
    """Weighted forecast of smoothing, Holt, theta, drift and mean; EWMA volatility."""

    def ses(x, a):
        s, err = x[0], 0.0
        for v in x[1:]:
            err += (v - s) ** 2
            s += a * (v - s)
        return s, err

    x = values
    if len(x) < 10:
        return {"forecast": float(x[-1]) if len(x) else math.nan, "direction": 0, "confidence": 0.0, "volatility": 0.0}
    flat = min((ses(x, a / 10) for a in range(1, 10)), key=lambda t: t[1])[0]
    level, trend = x[0], x[1] - x[0]
    for v in x[1:]:
        old = level
        level = 0.3 * v + 0.7 * (level + trend)
        trend = 0.1 * (level - old) + 0.9 * trend
    slope = np.polyfit(np.arange(len(x)), x, 1)[0]
    parts = np.array([flat, level + horizon * trend, flat + horizon * slope / 2, x[-1] + horizon * (x[-1] - x[0]) / (len(x) - 1), x[-10:].mean()])
    point = float(parts @ [0.15, 0.25, 0.30, 0.20, 0.10])
    r, var = np.diff(x) / x[:-1], 0.0
    for v in r:
        var = 0.94 * var + 0.06 * v * v
    move = point / x[-1] - 1
    return {"forecast": point, "direction": int(np.sign(move)) if abs(move) > 0.005 else 0, "confidence": float(np.clip(1 - 2 * parts.std() / abs(parts.mean()), 0, 1)), "volatility": float(np.sqrt(var * 252))}


#: Scenarios: a market's return and volatility. Fixed values.
SCENARIOS = {
    "covid_crash_2020": (-0.34, 0.80),
    "financial_crisis_2008": (-0.50, 0.60),
    "dot_com_crash_2000": (-0.45, 0.40),
    "flash_crash_2010": (-0.10, 1.50),
    "mild_correction": (-0.10, 0.25),
    "severe_bear": (-0.30, 0.50),
}


def stress(series_stats: DataFrame) -> DataFrame:
    """Closed-form losses of each symbol (symbol, volatility) under the scenarios; beta is the volatility against 16 percent, from 0.1 to 5."""
    spark = series_stats.sparkSession
    shocks = spark.createDataFrame([(k, *v) for k, v in SCENARIOS.items()], "scenario string, shock double, market_volatility double")
    beta = F.least(F.greatest(F.col("volatility") / 0.16, F.lit(0.1)), F.lit(5.0))
    loss = F.greatest(F.col("shock") * beta, F.lit(-0.99))
    grade = F.when(F.col("loss") > -0.1, "A").when(F.col("loss") > -0.2, "B").when(F.col("loss") > -0.35, "C").when(F.col("loss") > -0.5, "D").otherwise("F")
    return series_stats.crossJoin(F.broadcast(shocks)).select("symbol", "scenario", "market_volatility", beta.alias("beta"), loss.alias("loss")).withColumn("recovery", -F.col("loss") / F.nullif(1 + F.col("loss"), F.lit(0.0))).withColumn("grade", grade)


def dna_of(values: np.ndarray) -> dict:
    """Fingerprint of an equity curve in [0, 1]: trend, volatility link, drawdown, wins, dispersion, inequality."""
    r = np.diff(values) / values[:-1]
    r = r[np.isfinite(r)]
    if len(r) < 20 or r.std() == 0:
        return {"dna": [0.5] * 6}
    vol = pd.Series(np.abs(r)).rolling(10).mean().to_numpy()
    ok = np.isfinite(vol[:-1])
    dd = float((values / np.maximum.accumulate(values) - 1).min())
    a = np.sort(np.abs(r))
    gini = float((2 * np.arange(1, len(a) + 1) - len(a) - 1) @ a / (len(a) * a.sum()))
    corr = lambda x, y: float(np.nan_to_num(np.corrcoef(x, y)[0, 1]))
    return {"dna": [(corr(r[1:], r[:-1]) + 1) / 2, (corr(vol[:-1][ok], r[1:][ok]) + 1) / 2, 1 / (1 + math.exp(10 * (dd + 0.3))), float((r > 0).mean()), float(np.clip(abs(r.mean()) / r.std(), 0, 1)), gini]}


def similar(dna: DataFrame, n: int = 3) -> DataFrame:
    """The n most alike by cosine of their fingerprints: a theta self-join of a small table of strategies."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    a, b = dna.select(F.col("symbol").alias("a"), F.col("dna").alias("x")), dna.select(F.col("symbol").alias("b"), F.col("dna").alias("y"))
    j = a.join(b, F.col("a") != F.col("b")).withColumn("cosine", dot(F.col("x"), F.col("y")) / F.nullif(F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("y"), F.col("y"))), F.lit(0.0)))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b"))).where(F.col("rank") <= n).select("a", "b", "rank", "cosine")


def health(perf: DataFrame) -> DataFrame:
    """Score and grade of performance rows (sharpe, max_drawdown, total_return, volatility)."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))
    score = 0.25 * clip(F.col("sharpe") * 40 + 30) + 0.2 * clip(100 + F.col("max_drawdown") * 200) + 0.25 * clip(50 + F.col("total_return") * 50) + 0.3 * clip(100 - F.col("volatility") * 100)
    s = F.col("score")
    grade = F.when(s >= 90, "A+").when(s >= 80, "A").when(s >= 70, "B").when(s >= 60, "C").when(s >= 50, "D").otherwise("F")
    return perf.withColumn("score", score).withColumn("grade", grade)


def optimal_weights(mean: np.ndarray, cov: np.ndarray, goal: str = "sharpe", rf: float = 0.035, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    """Weights within bounds that sum to 1: equal, min_vol, sharpe, risk_parity, mean_variance. Projected gradient on small matrices."""
    n = len(mean)
    w = np.full(n, 1 / n)
    if goal == "equal" or n < 2:
        return w

    def project(v):
        a, b = (v - high).min() - 1, (v - low).max() + 1
        for _ in range(80):
            mid = (a + b) / 2
            a, b = (mid, b) if np.clip(v - mid, low, high).sum() > 1 else (a, mid)
        return np.clip(v - (a + b) / 2, low, high)

    def loss(w):
        var = float(w @ cov @ w)
        if goal == "min_vol":
            return var
        if goal == "risk_parity":
            part = w * (cov @ w)
            return float(((part - part.mean()) ** 2).sum() / max(var, 1e-18) ** 2)
        return -(mean @ w - rf) / math.sqrt(max(var, 1e-18)) if goal == "sharpe" else var / 2 - mean @ w

    best, step = loss(w), 0.5
    for _ in range(600):
        g = np.array([(loss(w + 1e-6 * e) - best) / 1e-6 for e in np.eye(n)])
        new = project(w - step * g / (np.abs(g).max() or 1))
        if (x := loss(new)) < best - 1e-15:
            w, best = new, x
        else:
            step /= 2
            if step < 1e-9:
                break
    return w


def _moments(series: DataFrame) -> tuple[pd.Series, np.ndarray]:
    """Annual means by symbol and the covariances: Spark reduces returns to n x n numbers."""
    from tidebar.plans.metrics import RETURNS

    r = steps.query(f"SELECT symbol, ts, r FROM ({RETURNS}) WHERE r IS NOT NULL", series=series)
    mom = r.join(r.withColumnRenamed("symbol", "s2").withColumnRenamed("r", "r2"), "ts").groupBy("symbol", "s2").agg((F.covar_samp("r", "r2") * 252).alias("cov"), (F.avg("r") * 252).alias("mean")).toPandas()
    cov = mom.pivot(index="symbol", columns="s2", values="cov").sort_index().sort_index(axis=1)
    return mom[mom.symbol == mom.s2].set_index("symbol")["mean"].sort_index(), cov.to_numpy()


def portfolio(series: DataFrame, goal: str = "sharpe") -> pd.DataFrame:
    """Weights by symbol; the small problem is solved on the driver."""
    mean, cov = _moments(series)
    return pd.DataFrame({"symbol": mean.index, "weight": optimal_weights(mean.to_numpy(), cov, goal)})


def frontier(series: DataFrame, points: int = 50, rf: float = 0.035) -> pd.DataFrame:
    """Least volatility for returns evenly spaced from the lowest mean to the highest: (target, volatility, sharpe, weights).

    Best weights are linear in the return between the frontier's corners, so a sweep over the tolerance of risk is interpolated."""
    mean, cov = _moments(series)
    mu = mean.to_numpy()
    tolerance = np.geomspace(1e-3, 1e2, 14) * max(np.trace(cov) / len(mu), 1e-12) / max(np.ptp(mu), 1e-12)
    sweep = [np.eye(len(mu))[mu.argmin()], *[optimal_weights(t * mu, cov, "mean_variance") for t in (*-tolerance[::-1], 0.0, *tolerance)], np.eye(len(mu))[mu.argmax()]]
    sweep.sort(key=lambda w: mu @ w)
    at = np.array([mu @ w for w in sweep])
    rows = []
    for target in np.linspace(mu.min(), mu.max(), points):
        i = int(np.clip(np.searchsorted(at, target), 1, len(at) - 1))
        share = (target - at[i - 1]) / (at[i] - at[i - 1]) if at[i] > at[i - 1] else 0.0
        w = (1 - share) * sweep[i - 1] + share * sweep[i]
        vol = math.sqrt(max(w @ cov @ w, 0.0))
        rows.append((float(target), vol, (target - rf) / vol if vol else 0.0, dict(zip(mean.index, map(float, w)))))
    return pd.DataFrame(rows, columns=["target", "volatility", "sharpe", "weights"])


def consensus(bars: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Votes of six rules a bar, and the consensus where one side has the threshold's share."""
    from tidebar.operators.indicators import bollinger, rsi_sma
    from tidebar.operators.steps import ROW, prior, roll

    df = bars
    for step in (ROW, {"m20": roll("avg", "close", 20), "m50": roll("avg", "close", 50), "hh": prior("max", "high", 20), "ll": prior("min", "low", 20), "v20": roll("avg", "volume", 20), "old": "lag(close, 10) OVER (PARTITION BY symbol ORDER BY ts)"}, *rsi_sma().steps, *bollinger().steps[:2]):
        df = df.selectExpr("*", *[f"{e} AS {c}" for c, e in step.items()])
    votes = ["CASE WHEN m20 > m50 THEN 1 WHEN m20 < m50 THEN -1 ELSE 0 END", "CASE WHEN close > old THEN 1 WHEN close < old THEN -1 ELSE 0 END", "CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END",
             "CASE WHEN close < lower THEN 1 WHEN close > upper THEN -1 ELSE 0 END", "CASE WHEN close > hh THEN 1 WHEN close < ll THEN -1 ELSE 0 END", "CASE WHEN volume > 1.5 * v20 THEN CAST(sign(close - open) AS INT) ELSE 0 END"]
    v = df.selectExpr("symbol", "ts", "close", f"array({', '.join(votes)}) AS votes").selectExpr("symbol", "ts", "close", "size(filter(votes, x -> x = 1)) AS buys", "size(filter(votes, x -> x = -1)) AS sells")
    cast = F.nullif(F.col("buys") + F.col("sells"), F.lit(0))
    return v.withColumn("signal", F.when(F.col("buys") / cast >= threshold, 1).when(F.col("sells") / cast >= threshold, -1).otherwise(0)).withColumn("strength", F.coalesce(F.greatest("buys", "sells") / cast, F.lit(0.0)))


def pairs_signals(spread: DataFrame, enter: float = 2.0, leave: float = 0.5, stop: float = 3.5) -> DataFrame:
    """State machine over a pair's z-scores (pair, ts, z): a row where a position opens or closes."""

    def run(pdf):
        side, rows = 0, []
        for ts, z in zip(pdf.sort_values("ts").ts, pdf.sort_values("ts").z):
            if z is None or np.isnan(z):
                continue
            if side == 0 and enter <= abs(z) < stop:
                side = -1 if z > 0 else 1
                rows.append((pdf["pair"].iloc[0], ts, "SHORT" if side < 0 else "LONG", z))
            elif side and (abs(z) <= leave or abs(z) >= stop):
                side = 0
                rows.append((pdf["pair"].iloc[0], ts, "CLOSE", z))
        return pd.DataFrame(rows, columns=["pair", "ts", "action", "z"])

    return spread.groupBy("pair").applyInPandas(run, "pair string, ts timestamp, action string, z double")


def factor_fit(returns: DataFrame, factors: list[str]) -> DataFrame:
    """Least squares of r on factors a symbol: Spark sums the cross products, a small solve a symbol does the rest."""
    names = ["one", *factors]
    x = returns.withColumn("one", F.lit(1.0)).dropna(subset=["r", *factors])
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"x_{a}_{b}") for i, a in enumerate(names) for b in names[i:]] + [F.sum(F.col(a) * F.col("r")).alias(f"y_{a}") for a in names] + [F.sum(F.col("r") * F.col("r")).alias("yy"), F.count("*").alias("n")]

    def run(batches):
        for pdf in batches:
            rows = []
            for s in pdf.to_dict("records"):
                a = np.array([[s[f"x_{min(p, q, key=names.index)}_{max(p, q, key=names.index)}"] for q in names] for p in names])
                y = np.array([s[f"y_{p}"] for p in names])
                beta = np.linalg.lstsq(a, y, rcond=None)[0]
                rss, n, k = max(s["yy"] - beta @ y, 0.0), s["n"], len(names)
                se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(a)) * rss / max(n - k, 1), 1e-300))
                tss = s["yy"] - s["y_one"] ** 2 / n
                rows += [(s["symbol"], p, float(b), float(b / e), stats.t_p(float(b / e), n - k), 1 - rss / tss if tss else 0.0) for p, b, e in zip(names, beta, se)]
            yield pd.DataFrame(rows, columns=["symbol", "factor", "beta", "t", "p", "r2"])

    return x.groupBy("symbol").agg(*sums).mapInPandas(run, "symbol string, factor string, beta double, t double, p double, r2 double")


def attribution(returns: DataFrame, fit: DataFrame, factors: list[str]) -> DataFrame:
    """Each day's return as the fit's intercept, a part a factor, and what is left: (symbol, ts, r, alpha, <factor>_part..., residual)."""
    beta = fit.groupBy("symbol").agg(*[F.max(F.when(F.col("factor") == f, F.col("beta"))).alias(f"b_{f}") for f in ("one", *factors)])
    parts = {f: F.col(f"b_{f}") * F.col(f) for f in factors}
    j = returns.dropna(subset=["r", *factors]).join(beta, "symbol")
    return j.select("symbol", "ts", "r", F.col("b_one").alias("alpha"), *[e.alias(f"{f}_part") for f, e in parts.items()], (F.col("r") - F.col("b_one") - sum(parts.values())).alias("residual"))


def rolling_max_drawdown(series: DataFrame, n: int = 252) -> DataFrame:
    """Deepest fall within the last n values, from the second on: a fold over each window's list."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1 - n, 0)

    def step(s: Column, v: Column) -> Column:
        top = F.greatest(s["top"], v)
        return F.struct(top.alias("top"), F.least(s["fall"], v / F.nullif(top, F.lit(0.0)) - 1).alias("fall"))

    fold = F.aggregate(F.collect_list("value").over(w), F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("fall")), step, lambda s: s["fall"])
    return series.select("symbol", "ts", F.when(F.count("value").over(w) >= 2, fold).alias("max_drawdown"))


def inversions(y: np.ndarray) -> int:
    """Pairs in the wrong order, by halves."""
    if len(y) < 2:
        return 0
    h = len(y) // 2
    across = h - np.searchsorted(np.sort(y[:h]), y[h:], side="right")
    return inversions(y[:h]) + inversions(y[h:]) + int(across.sum())


def kendall_of(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b in n log(n)^2."""
    tied = lambda *cols: int(sum(c * (c - 1) // 2 for c in np.unique(np.column_stack(cols), axis=0, return_counts=True)[1].tolist()))
    n = len(x)
    all_, tx, ty = n * (n - 1) // 2, tied(x), tied(y)
    if all_ in (tx, ty):
        return 0.0
    order = np.lexsort((y, x))
    return (all_ - tx - ty + tied(x, y) - 2 * inversions(y[order])) / math.sqrt((all_ - tx) * (all_ - ty))


def correlation_tests(pairs: DataFrame) -> DataFrame:
    """Pearson, Spearman and Kendall of pairs of returns (a, b, x, y) with their two-sided p-values."""

    def run(pdf):
        x, y, n = pdf.x.to_numpy(float), pdf.y.to_numpy(float), len(pdf)
        out = {"a": pdf.a.iloc[0], "b": pdf.b.iloc[0], "n": n}
        for name, r in (("pearson", pdf.x.corr(pdf.y)), ("spearman", pdf.x.rank().corr(pdf.y.rank()))):
            r = 0.0 if n < 3 or np.isnan(r) else float(r)
            out |= {name: r, f"{name}_p": stats.t_p(r * math.sqrt((n - 2) / max(1 - r * r, 1e-300)), n - 2) if n > 2 else 1.0}
        tau = kendall_of(x, y)
        return pd.DataFrame([out | {"kendall": tau, "kendall_p": math.erfc(abs(3 * tau * math.sqrt(n * (n - 1)) / math.sqrt(2 * (2 * n + 5))) / math.sqrt(2))}])

    return pairs.groupBy("a", "b").applyInPandas(run, "a string, b string, n long, pearson double, pearson_p double, spearman double, spearman_p double, kendall double, kendall_p double")


def rolling_factors(returns: DataFrame, factors: list[str], n: int = 60) -> DataFrame:
    """Least squares over the last n rows at every row: windows sum the cross products, small solves do the rest."""
    names = ["one", *factors]
    x = returns.dropna(subset=["r", *factors]).withColumn("one", F.lit(1.0))
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1 - n, 0)
    gram = [F.sum(F.col(a) * F.col(b)).over(w) for a in names for b in names]
    sums = x.select("symbol", "ts", F.array(*gram).alias("gram"), F.array(*[F.sum(F.col(a) * F.col("r")).over(w) for a in names]).alias("cross"), F.count("*").over(w).alias("n")).where(F.col("n") == n)
    k = len(names)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                a, y = np.stack(pdf.gram).reshape(-1, k, k), np.stack(pdf.cross)
                beta = np.einsum("nij,nj->ni", np.linalg.pinv(a, hermitian=True), y)
                yield pd.DataFrame({"symbol": pdf.symbol, "ts": pdf.ts, "alpha": beta[:, 0], **{f: beta[:, i + 1] for i, f in enumerate(factors)}})

    return sums.mapInPandas(run, ", ".join(["symbol string", "ts timestamp", "alpha double", *[f"{f} double" for f in factors]]))


def factor_risk(returns: DataFrame, fit: DataFrame, factors: list[str]) -> DataFrame:
    """Annual variance of each symbol as a part a factor (beta' S beta) and a specific one, from joint moments of factors and residuals."""
    parts = attribution(returns, fit, factors)
    total = sum(F.col(f"{f}_part") for f in factors)
    m = parts.groupBy("symbol").agg((F.var_samp("r") * 252).alias("total"), *[(F.covar_samp(F.col(f"{f}_part"), total) * 252).alias(f"{f}_risk") for f in factors], (F.var_samp("residual") * 252).alias("specific"))
    explained = sum(F.col(f"{f}_risk") for f in factors)
    return m.withColumn("factor_share", explained / F.nullif(explained + F.col("specific"), F.lit(0.0)))


def low_correlation(corr: DataFrame, n: int = 3) -> list[str]:
    """Symbols chosen one by one, each with the least mean absolute correlation to those before it; starts from the least correlated pair. corr: (a, b, corr), a row a pair of a bounded universe."""
    rows = corr.toPandas()
    if rows.empty:
        return []
    c = {(a, b): abs(v) for a, b, v in zip(rows.a, rows.b, rows["corr"].fillna(0.0))}
    c |= {(b, a): v for (a, b), v in c.items()}
    names = sorted({a for a, _ in c})
    chosen = list(min(sorted(k for k in c if k[0] < k[1]), key=lambda k: c[k]))
    while len(chosen) < min(n, len(names)):
        chosen.append(min((s for s in names if s not in chosen), key=lambda s: (sum(c.get((s, t), 0.0) for t in chosen), s)))
    return chosen[:n]


def clusters(corr: DataFrame, k: int = 2, starts: int = 10, seed: int = 42) -> pd.DataFrame:
    """Symbols grouped by their rows of the correlation matrix: k-means of a small matrix, the best of some starts."""
    rows = corr.toPandas()
    names = sorted({*rows.a, *rows.b})
    m = pd.DataFrame(np.eye(len(names)), names, names)
    for a, b, v in zip(rows.a, rows.b, rows["corr"].fillna(0.0)):
        m.loc[a, b] = m.loc[b, a] = v
    x, rng, best = m.to_numpy(), np.random.default_rng(seed), (np.inf, None)
    for _ in range(starts):
        mid = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(100):
            label = ((x[:, None] - mid) ** 2).sum(2).argmin(1)
            new = np.array([x[label == i].mean(0) if (label == i).any() else mid[i] for i in range(len(mid))])
            if np.allclose(new, mid):
                break
            mid = new
        best = min(best, (float(((x - mid[label]) ** 2).sum()), tuple(label)), key=lambda t: t[0])
    first = {v: i for i, v in enumerate(dict.fromkeys(best[1]))}
    return pd.DataFrame({"symbol": names, "cluster": [first[v] for v in best[1]]})


def strength_buckets(votes: DataFrame, n: int = 10) -> DataFrame:
    """Accuracy and mean gain of signals (symbol, ts, close, signal, strength) over the next n bars, by strength."""
    w = Window.partitionBy("symbol").orderBy("ts")
    gain = F.col("signal") * (F.lead("close", n).over(w) / F.nullif(F.col("close"), F.lit(0.0)) - 1)
    edges = (0.4, 0.5, 0.6, 0.7, 0.8)
    bucket = sum(((F.col("strength") >= e).cast("int") for e in edges), F.lit(0))
    j = votes.withColumn("gain", gain).where((F.col("signal") != 0) & F.col("gain").isNotNull()).withColumn("bucket", F.element_at(F.array(*[F.lit(f"{a:g}-{b:g}") for a, b in zip((0.0, *edges), (*edges, 1.0))]), bucket + 1))
    won, lost = F.sum(F.greatest("gain", F.lit(0.0))), -F.sum(F.least("gain", F.lit(0.0)))
    return j.groupBy("bucket").agg(F.count("*").alias("n"), F.avg((F.col("gain") > 0).cast("double")).alias("accuracy"), F.avg("gain").alias("mean_gain"), (won / F.nullif(lost, F.lit(0.0))).alias("profit_factor"))


def combined(curves: DataFrame, by: str = "equal") -> DataFrame:
    """Several strategies' equity (symbol, strategy, ts, value) as one: daily returns weighted equally, by total return (performance) or by Sharpe, of which the least counted is 0.001 percent and 0.01."""
    w = Window.partitionBy("symbol", "strategy").orderBy("ts")
    r = curves.withColumn("r", F.col("value") / F.nullif(F.lag("value").over(w), F.lit(0.0)) - 1)
    raw = {"equal": F.lit(1.0), "performance": F.greatest(F.coalesce((F.max_by("value", "ts") / F.nullif(F.min_by("value", "ts"), F.lit(0.0)) - 1) * 100, F.lit(0.0)), F.lit(0.001)),
           "sharpe": F.greatest(F.coalesce((F.avg("r") - 0.035 / 252) / F.nullif(F.stddev_samp("r"), F.lit(0.0)) * np.sqrt(252), F.lit(0.0)), F.lit(0.01))}[by]
    score = r.groupBy("symbol", "strategy").agg(raw.alias("score"))
    weights = score.select("symbol", "strategy", (F.col("score") / F.sum("score").over(Window.partitionBy("symbol"))).alias("weight"))
    day = r.where("r IS NOT NULL").join(weights, ["symbol", "strategy"]).groupBy("symbol", "ts").agg(F.sum(F.col("weight") * F.col("r")).alias("r"))
    return day.select("symbol", "ts", "r", F.exp(F.sum(F.log1p(F.greatest("r", F.lit(-0.999999)))).over(Window.partitionBy("symbol").orderBy("ts"))).alias("growth"))


def voted(signals: DataFrame, share: float = 0.5) -> DataFrame:
    """The side that `share` of the strategies (symbol, ts, strategy, signal) or more are on, buying first, else 0."""
    n = F.count("*")
    buys, sells = (F.sum((F.col("signal") == k).cast("int")) for k in (1, -1))
    return signals.groupBy("symbol", "ts").agg(F.when(buys / n >= share, 1).when(sells / n >= share, -1).otherwise(0).alias("signal"))


#: How sure strategies are in a regime. Fixed values.
LEARNED = {
    "strong_uptrend": {"MACD": 0.95, "SMA Cross": 0.85, "Breakout": 0.80},
    "uptrend": {"SMA Cross": 0.90, "Trend Filter": 0.85, "Mean Reversion": 0.75},
    "sideways": {"SMA Cross": 0.85, "MACD": 0.75, "Breakout": 0.70},
    "downtrend": {"Trend Filter": 0.95, "Mean Reversion": 0.80, "Breakout": 0.70},
    "strong_downtrend": {"Mean Reversion": 0.95, "Trend Filter": 0.85, "Breakout": 0.60},
    "high_volatility": {"MACD": 0.85, "SMA Cross": 0.80, "Mean Reversion": 0.75, "Breakout": 0.70},
}
#: Regimes that strategies are made for. Fixed values.
MADE_FOR = {"SMA Cross": ("uptrend", "strong_uptrend"), "MACD": ("uptrend", "strong_uptrend"), "Breakout": ("strong_uptrend", "strong_downtrend"), "Mean Reversion": ("sideways", "high_volatility"), "Trend Filter": ("uptrend", "sideways")}

#: For low and high risk. Fixed values.
RISK = {"SMA Cross": 0.0, "MACD": 0.0, "Breakout": -0.02, "Mean Reversion": 0.02, "Trend Filter": 0.02}


def advice(regimes: DataFrame, n: int = 3) -> DataFrame:
    """The strategies best scored for each symbol's last regime (symbol, ts, regime, adx): 0.3, half of how sure they are, 0.1 where made for it, 0.05 where the trend's strength suits, 0.02 for or against their risk."""
    now = regimes.groupBy("symbol").agg(F.max_by(F.struct("regime", "adx"), "ts").alias("now")).select("symbol", "now.*")
    table = regimes.sparkSession.createDataFrame([(r, s, 0.3 + 0.5 * sure.get(s, 0.0) + 0.1 * (r in MADE_FOR[s]) + RISK[s]) for r, sure in LEARNED.items() for s in MADE_FOR], "regime string, strategy string, base double")
    trend = F.when((F.col("adx") > 30) & F.col("strategy").isin("SMA Cross", "MACD", "Breakout"), 0.05).when((F.col("adx") < 20) & (F.col("strategy") == "Mean Reversion"), 0.05).otherwise(0.0)
    scored = now.join(F.broadcast(table), "regime").withColumn("score", F.least(F.col("base") + trend, F.lit(1.0)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("score").desc(), "strategy"))).where(F.col("rank") <= n).select("symbol", "regime", "strategy", "rank", "score")
