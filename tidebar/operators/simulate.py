"""Trade simulation: many runs over one symbol's bars at once, bar by bar, each run a lane of NumPy vectors.

`sweep` keeps state only (cash, shares, running metrics), so a thousand runs never materialize their equity; `trace`
writes the equity and the trades of the runs that are asked for. Runs, not bars, are what scales out: a group is a symbol
and a block of runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Money and frictions. fill: on the signal's close, or on the next bar's open. stop, take, trail: percent (0: none)."""

    cash: float = 10_000_000.0
    commission: float = 0.00015
    tax: float = 0.0018
    slippage: float = 0.001
    invest: float = 0.95
    fill: str = "close"
    stop: float = 0.0
    take: float = 0.0
    trail: float = 0.0
    double_slippage: bool = False


def rsi_of(close: np.ndarray, n: int) -> np.ndarray:
    d = pd.Series(close).diff().fillna(0)
    g, l = d.clip(lower=0).rolling(n).mean(), (-d.clip(upper=0)).rolling(n).mean()
    return (100 - 100 / (1 + g / l.replace(0, np.nan))).where(l != 0, 100).to_numpy()


def crossed(f: np.ndarray, s: np.ndarray) -> np.ndarray:
    out = np.zeros(len(f), np.int8)
    with np.errstate(invalid="ignore"):
        out[1:][(f[:-1] <= s[:-1]) & (f[1:] > s[1:])] = 1
        out[1:][(f[:-1] >= s[:-1]) & (f[1:] < s[1:])] = -1
    return out


def golden_cross(b: pd.DataFrame, fast=10, slow=30, **_):
    return crossed(b.close.rolling(int(fast)).mean().to_numpy(), b.close.rolling(int(slow)).mean().to_numpy())


def rsi(b: pd.DataFrame, period=14, oversold=30, overbought=70, **_):
    r = rsi_of(b.close.to_numpy(float), int(period))
    up, down = crossed(r, np.full(len(r), float(oversold))), crossed(r, np.full(len(r), float(overbought)))
    return np.where(up == 1, 1, np.where(down == -1, -1, 0)).astype(np.int8)


def macd(b: pd.DataFrame, fast=12, slow=26, signal=9, **_):
    e = lambda x, n: x.ewm(span=int(n), adjust=False).mean()
    m = e(b.close, fast) - e(b.close, slow)
    return crossed(m.to_numpy(), e(m, signal).to_numpy())


def bollinger(b: pd.DataFrame, period=20, k=2.0, **_):
    m, s = b.close.rolling(int(period)).mean(), b.close.rolling(int(period)).std(ddof=0)
    low, c = m - k * s, b.close
    buy = (c.shift() <= low.shift()) & (c > low)
    return np.where(c >= m + k * s, -1, np.where(buy, 1, 0)).astype(np.int8)


def breakout(b: pd.DataFrame, period=20, **_):
    hh, ll = b.high.rolling(int(period)).max().shift(), b.low.rolling(int(period)).min().shift()
    return np.where(b.close > hh, 1, np.where(b.close < ll, -1, 0)).astype(np.int8)


STRATEGIES: dict[str, Callable] = {"goldenCross": golden_cross, "rsi": rsi, "macd": macd, "bollinger": bollinger, "breakout": breakout}


def lanes(b: pd.DataFrame, signal: np.ndarray, rules: Rules, keep: bool = False):
    """signal: bars x runs. Returns metrics (a dict of arrays, a value a run) and, if keep, (equity, trades)."""
    n, m = signal.shape
    close, open_ = b.close.to_numpy(float), b.open.to_numpy(float)
    high = b.high.to_numpy(float)
    cash, shares, entry, top = np.full(m, rules.cash), np.zeros(m), np.zeros(m), np.zeros(m)
    buys, sells, wins, won, lost = (np.zeros(m) for _ in range(5))
    peak, mdd, dur, longest = np.full(m, -np.inf), np.zeros(m), np.zeros(m), np.zeros(m)
    last, s1, s2, c1 = np.full(m, np.nan), np.zeros(m), np.zeros(m), 0
    n1, n2, nc = np.zeros(m), np.zeros(m), np.zeros(m)  # of negative returns
    equity = np.zeros((n, m)) if keep else None
    trades: list[tuple] = []
    fill_open = rules.fill == "open"
    want = np.zeros(m, np.int8)
    sell_at, buy_at = 1 - rules.slippage, 1 + rules.slippage

    def sell(who, price, t):
        nonlocal cash, shares
        got = shares * price * sell_at
        fee = got * (rules.commission + rules.tax)
        extra = shares * price * rules.slippage if rules.double_slippage else 0.0
        pnl = got - fee - shares * entry
        if keep:
            trades.extend((t, r, "SELL", price * sell_at, shares[r], pnl[r]) for r in np.flatnonzero(who))
        cash = np.where(who, cash + got - fee - extra, cash)
        sells[who] += 1
        wins[who & (pnl > 0)] += 1
        won[who] += np.maximum(pnl, 0)[who]
        lost[who] += np.maximum(-pnl, 0)[who]
        shares = np.where(who, 0.0, shares)

    def buy(who, price, t):
        nonlocal cash, shares
        q = np.floor(cash * rules.invest / (price * buy_at))
        cost = q * price * buy_at
        who = who & (q > 0) & (cost * (1 + rules.commission) <= cash)
        extra = q * price * rules.slippage if rules.double_slippage else 0.0
        if keep:
            trades.extend((t, r, "BUY", price * buy_at, q[r], 0.0) for r in np.flatnonzero(who))
        cash = np.where(who, cash - cost * (1 + rules.commission) - extra, cash)
        shares = np.where(who, q, shares)
        entry[who] = price * buy_at
        top[who] = price
        buys[who] += 1

    for i in range(n):
        if fill_open and i:
            if (x := (want == -1) & (shares > 0)).any():
                sell(x, open_[i], i)
            if (x := (want == 1) & (shares == 0)).any():
                buy(x, open_[i], i)
        held = shares > 0
        if held.any() and (rules.stop or rules.take or rules.trail):
            top = np.where(held, np.maximum(top, high[i]), top)
            out = np.zeros(m, bool)
            gain = np.where(held, close[i] / np.where(entry > 0, entry, 1) - 1, 0.0) * 100
            if rules.stop:
                out |= gain <= -rules.stop
            if rules.take:
                out |= gain >= rules.take
            if rules.trail:
                out |= close[i] <= top * (1 - rules.trail / 100)
            if (out := out & held).any():
                sell(out, close[i], i)
        sig = signal[i]
        if fill_open:
            want = sig
        else:
            down = (sig == -1) & (shares > 0)
            up = (sig == 1) & (shares == 0)
            if down.any():
                sell(down, close[i], i)
            if up.any():
                buy(up, close[i], i)
        now = cash + shares * close[i]
        if keep:
            equity[i] = now
        peak = np.maximum(peak, now)
        dd = (now - peak) / peak
        mdd = np.minimum(mdd, dd)
        dur = np.where(dd < 0, dur + 1, 0)
        longest = np.maximum(longest, dur)
        if i:
            r = now / last - 1
            s1 += r
            s2 += r * r
            c1 += 1
            low = np.minimum(r, 0)
            n1 += low
            n2 += low * low
            nc += r < 0
        last = now
    mean = s1 / max(c1, 1)
    std = np.sqrt(np.maximum(s2 / max(c1, 1) - mean**2, 0))
    total = (last / rules.cash - 1) * 100 if n else np.zeros(m)
    with np.errstate(all="ignore"):
        annual = (np.sign(1 + total / 100) * np.abs(1 + total / 100) ** (252 / max(n, 1)) - 1) * 100
        down = np.sqrt(np.maximum(n2 - n1**2 / np.maximum(nc, 1), 0) / np.maximum(nc - 1, 1)) * np.sqrt(252) * 100
        metrics = {
            "total_return": total,
            "annual_return": annual,
            "sortino": np.where(down > 1e-12, (annual - 3.5) / np.where(down > 1e-12, down, 1), 0.0),
            "calmar": np.where(mdd < 0, annual / np.where(mdd < 0, -mdd * 100, 1), 0.0),
            "volatility": std * np.sqrt(252) * 100,
            "sharpe": np.where(std > 1e-15, (mean - 0.035 / 252) / np.where(std > 1e-15, std, 1) * np.sqrt(252), 0.0),
            "max_drawdown": mdd * 100,
            "mdd_duration": longest,
            "win_rate": np.where(sells > 0, wins / np.maximum(sells, 1) * 100, 0.0),
            "profit_factor": np.where(lost > 0, won / np.where(lost > 0, lost, 1), np.nan),
            "total_trades": buys + sells,
            "final_equity": last if n else np.full(m, rules.cash),
        }
    return metrics, (equity, trades)


METRICS = ("total_return", "annual_return", "volatility", "sharpe", "sortino", "calmar", "max_drawdown", "mdd_duration", "win_rate", "profit_factor", "total_trades", "final_equity")
BLOCK = 250


def sweep(bars: DataFrame, params: DataFrame, strategy: str | Callable, rules: Rules = Rules(), block: int = BLOCK) -> DataFrame:
    """A row a symbol and run: params' columns (run_id and the strategy's parameters) and the metrics. params is broadcast: its rows are runs, a bounded grid."""
    make = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    names = [c for c in params.columns if c != "run_id"]
    runs = params.toPandas().sort_values("run_id", ignore_index=True)  # the grid, as its caller made it
    blocks = -(-max(len(runs), 1) // block)
    spread = bars.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(pdf):
        pdf = pdf.sort_values("ts", ignore_index=True)
        mine = runs.iloc[pdf.block.iloc[0] * block :][:block]
        signal = np.stack([make(pdf, **{k: r[k] for k in names}) for r in mine.to_dict("records")], axis=1)
        metrics, _ = lanes(pdf, signal, rules)
        return pd.DataFrame({"symbol": pdf.symbol.iloc[0], "run_id": mine.run_id.to_numpy(), **{k: metrics[k] for k in METRICS}})

    schema = ", ".join(["symbol string", "run_id long", *[f"{k} double" for k in METRICS]])
    return spread.groupBy("symbol", "block").applyInPandas(run, schema).join(F.broadcast(params), "run_id")


def trace(bars: DataFrame, strategy: str | Callable | None = None, rules: Rules = Rules(), what: str = "equity", **params) -> DataFrame:
    """Equity (symbol, ts, equity) or trades (symbol, ts, side, price, quantity, pnl) of one run a symbol; without a strategy bars carry `signal`."""
    make = STRATEGIES[strategy] if isinstance(strategy, str) else strategy

    def run(pdf):
        pdf = pdf.sort_values("ts", ignore_index=True)
        sig = (pdf.signal.fillna(0).to_numpy(np.int8) if make is None else make(pdf, **params)).reshape(-1, 1)
        _, (equity, trades) = lanes(pdf, sig, rules, keep=True)
        if what == "equity":
            return pd.DataFrame({"symbol": pdf.symbol, "ts": pdf.ts, "equity": equity[:, 0]})
        t = pd.DataFrame(trades, columns=["i", "run", "side", "price", "quantity", "pnl"])
        return pd.DataFrame({"symbol": pdf.symbol.iloc[0], "ts": pdf.ts.to_numpy()[t.i.to_numpy(int)], "side": t.side, "price": t.price.astype(float), "quantity": t.quantity.astype(float), "pnl": t.pnl.astype(float)})

    schema = "symbol string, ts timestamp, equity double" if what == "equity" else "symbol string, ts timestamp, side string, price double, quantity double, pnl double"
    return bars.groupBy("symbol").applyInPandas(run, schema)


def backtest(bars: DataFrame, strategy: str | Callable | None = None, rules: Rules = Rules(), **params) -> DataFrame:
    """Metrics of one run a symbol; without a strategy bars carry `signal`."""
    make = STRATEGIES[strategy] if isinstance(strategy, str) else strategy

    def run(pdf):
        pdf = pdf.sort_values("ts", ignore_index=True)
        sig = (pdf.signal.fillna(0).to_numpy(np.int8) if make is None else make(pdf, **params)).reshape(-1, 1)
        metrics, _ = lanes(pdf, sig, rules)
        return pd.DataFrame({"symbol": pdf.symbol.iloc[:1], **{k: metrics[k] for k in METRICS}})

    return bars.groupBy("symbol").applyInPandas(run, ", ".join(["symbol string", *[f"{k} double" for k in METRICS]]))


def rebalanced(bars: DataFrame, weights: dict[str, float], rules: Rules = Rules(cash=100_000_000.0), every: str = "month") -> DataFrame:
    """Several symbols with one purse, brought back to the weights at the start of each month or week: (ts, equity, cash).

    Bars become one row a date first (a map of closes, one shuffle); the fold runs over dates, not over symbols' bars."""
    total = sum(weights.values())
    goal = {k: w / max(total, 1.0) for k, w in weights.items()}
    days = bars.where(F.col("symbol").isin(list(weights))).groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "close"))).alias("closes"))

    def run(pdf):
        pdf = pdf.sort_values("ts", ignore_index=True)
        period = pdf.ts.dt.to_period("M" if every == "month" else "W")
        cash, held, last, rows = rules.cash, dict.fromkeys(goal, 0.0), {}, []
        for i, (ts, closes) in enumerate(zip(pdf.ts, pdf.closes)):
            closes = dict(closes)
            last |= closes
            equity = cash + sum(q * last.get(k, 0.0) for k, q in held.items())
            if i == 0 or period[i] != period[i - 1]:
                deltas = {k: int(goal[k] * equity / closes[k]) - held[k] for k in sorted(goal) if closes.get(k) and abs(goal[k] - held[k] * closes[k] / equity) >= 0.01}
                for k, q in sorted(deltas.items(), key=lambda x: x[1]):  # sales first
                    price = closes[k] * (1 + rules.slippage * (1 if q > 0 else -1))
                    fee = abs(q) * price * (rules.commission + (rules.tax if q < 0 else 0))
                    if q > 0 and q * price + fee > cash:
                        q = max(0.0, float(int(cash / (price * (1 + rules.commission)))))
                        fee = q * price * rules.commission
                    cash -= q * price + fee
                    held[k] += q
                equity = cash + sum(q * last.get(k, 0.0) for k, q in held.items())
            rows.append((ts, equity, cash))
        return pd.DataFrame(rows, columns=["ts", "equity", "cash"])

    return days.withColumn("run", F.lit(0)).groupBy("run").applyInPandas(run, "ts timestamp, equity double, cash double")


def orders(bars: DataFrame, entry: DataFrame, stop: float, take: float, trail: float = 0.0) -> DataFrame:
    """Bracket orders: for each entry (order_id, symbol, ts, price) the first later bar that reaches the target (looked at first), the stop, or a trail below the highest high.

    An interval join on symbol and ts; the running high is a window over each order's bars."""
    from pyspark.sql import Window

    e = entry.select("order_id", "symbol", F.col("ts").alias("since"), F.col("price").alias("paid"))
    j = bars.join(e, "symbol").where(F.col("ts") > F.col("since"))
    w = Window.partitionBy("order_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("top", F.greatest(F.max("high").over(w), F.col("paid")))
    hit = F.when(F.col("high") >= F.col("paid") * (1 + take / 100), "take").when(F.col("low") <= F.col("paid") * (1 - stop / 100), "stop")
    if trail:
        hit = F.coalesce(hit, F.when(F.col("low") <= F.col("top") * (1 - trail / 100), "trail"))
    price = F.when(F.col("hit") == "take", F.col("paid") * (1 + take / 100)).when(F.col("hit") == "stop", F.col("paid") * (1 - stop / 100)).otherwise(F.col("top") * (1 - trail / 100))
    return j.withColumn("hit", hit).where("hit IS NOT NULL").withColumn("exit_price", price).groupBy("order_id", "symbol").agg(F.min_by(F.struct("ts", "hit", "exit_price"), "ts").alias("x")).select("order_id", "symbol", F.col("x.ts").alias("exit_ts"), "x.hit", "x.exit_price")


def shared(bars: DataFrame, rules: Rules = Rules(cash=100_000_000.0)) -> DataFrame:
    """Several symbols that carry `signal` and share one purse: (ts, equity, cash, positions).

    A purchase is for the equity's equal part; orders fill at the next date's open, sales first, and lapse where the symbol has no bar.
    One row a date goes to the fold, so its size is the number of dates."""
    row = F.struct("symbol", "open", "close", F.coalesce(F.col("signal"), F.lit(0)).cast("int").alias("signal"))
    days = bars.groupBy("ts").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def run(pdf):
        pdf = pdf.sort_values("ts", ignore_index=True)
        part = rules.invest / max(len({r["symbol"] for rows in pdf.rows for r in rows}), 1)
        cash, held, last, queue, out = rules.cash, {}, {}, [], []
        equity = cash
        for ts, rows in zip(pdf.ts, pdf.rows):
            today = {r["symbol"]: r for r in rows}
            for side, name in sorted(queue):
                price = today[name]["open"] * (1 + side * rules.slippage) if name in today else None
                if price is None:
                    continue
                if side < 0 and held.get(name):
                    cash += held.pop(name) * price * (1 - rules.commission - rules.tax)
                elif side > 0 and not held.get(name):
                    q = int(min(equity * part, cash * 0.99) / price)
                    if q > 0:
                        cash -= q * price * (1 + rules.commission)
                        held[name] = q
            last |= {k: r["close"] for k, r in today.items()}
            equity = cash + sum(q * last[k] for k, q in held.items())
            queue = [(r["signal"], k) for k, r in today.items() if r["signal"]]
            out.append((ts, equity, cash, len(held)))
        return pd.DataFrame(out, columns=["ts", "equity", "cash", "positions"])

    return days.withColumn("run", F.lit(0)).groupBy("run").applyInPandas(run, "ts timestamp, equity double, cash double, positions int")


def timed(signal: np.ndarray, hold: int) -> np.ndarray:
    """Signals that leave a position after `hold` bars at the latest."""
    out, since = np.zeros(len(signal), np.int8), None
    for i, s in enumerate(signal):
        if since is None and s == 1:
            out[i], since = 1, i
        elif since is not None and (s == -1 or i - since >= hold):
            out[i], since = -1, None
    return out


def signal_backtest(bars: DataFrame, hold: int = 10, draws: int = 20, seed: int = 42, rules: Rules = Rules(slippage=0.0005, tax=0.0)) -> DataFrame:
    """Bars that carry `signal` against holding and against as many entries at random dates; positions end on -1 or after `hold` bars."""

    def run(pdf):
        pdf = pdf.sort_values("ts", ignore_index=True)
        own = timed(pdf.signal.fillna(0).to_numpy(np.int8), hold)
        entries, runs = int((own == 1).sum()), [own]
        rng = np.random.default_rng([seed, *pdf.symbol.iloc[0].encode()])
        for _ in range(draws):
            at = np.zeros(len(pdf), np.int8)
            at[rng.choice(len(pdf), entries, replace=False)] = 1
            runs.append(timed(at, hold))
        m, _ = lanes(pdf, np.stack(runs, axis=1), rules)
        total = m["total_return"]
        out = {"entries": entries, "total_return": total[0], "sharpe": m["sharpe"][0], "max_drawdown": -m["max_drawdown"][0], "win_rate": m["win_rate"][0], "holding": (pdf.close.iloc[-1] / pdf.close.iloc[0] - 1) * 100, "random": total[1:].mean(), "better_than_random": (total[0] > total[1:]).mean()}
        return pd.DataFrame({"symbol": pdf.symbol.iloc[:1], **{k: [float(v)] for k, v in out.items()}})

    return bars.groupBy("symbol").applyInPandas(run, "symbol string, entries double, total_return double, sharpe double, max_drawdown double, win_rate double, holding double, random double, better_than_random double")
