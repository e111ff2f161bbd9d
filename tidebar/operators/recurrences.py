"""Indicators that depend on their own last value: a pass over each symbol's ordered bars in one Arrow-fed group.

Each is a function of a pandas frame ordered by ts; `apply` runs any number of them in one shuffle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Out = dict[str, np.ndarray]


def ewm(x, n: int) -> pd.Series:
    """Exponential mean with weight 2 / (n + 1), starting at the first value."""
    return pd.Series(x).ewm(span=n, adjust=False).mean()


def wilder(x: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """Mean of n values from `first` on, then (n - 1)/n of the last mean and 1/n of the new value."""
    out = np.full(len(x), np.nan)
    if len(x) >= first + n:
        out[first + n - 1] = x[first : first + n].mean()
        for i in range(first + n, len(x)):
            out[i] = (out[i - 1] * (n - 1) + x[i]) / n
    return out


def seeded_ema(x: np.ndarray, n: int) -> np.ndarray:
    """EMA that starts with the mean of the first n values (nulls before them are skipped)."""
    out = np.full(len(x), np.nan)
    valid = np.flatnonzero(~np.isnan(x))
    if len(valid) >= n:
        at = valid[n - 1]
        out[at] = x[valid[:n]].mean()
        k = 2 / (n + 1)
        for i in range(at + 1, len(x)):
            out[i] = k * x[i] + (1 - k) * out[i - 1]
    return out


def true_range(b: pd.DataFrame) -> np.ndarray:
    pc = b.close.shift()
    return pd.concat([b.high - b.low, (b.high - pc).abs(), (b.low - pc).abs()], axis=1).max(axis=1).to_numpy()


def guarded(out: Out, guard: int) -> Out:
    for v in out.values():
        v[: guard - 1] = np.nan
    return out


def _all(**cols) -> Out:
    return {k: np.array(v, float) for k, v in cols.items()}


def ema(b, n=20):
    return guarded(_all(ema=ewm(b.close, n)), n)


def macd(b, fast=12, slow=26, signal=9):
    m = ewm(b.close, fast) - ewm(b.close, slow)
    s = ewm(m, signal)
    return guarded(_all(macd=m, macd_signal=s, macd_hist=m - s), slow + signal)


def vema(b, n=20):
    return {"vema": seeded_ema(b.close.to_numpy(float), n)}


def vmacd(b, fast=12, slow=26, signal=9):
    c = b.close.to_numpy(float)
    m = seeded_ema(c, fast) - seeded_ema(c, slow)
    s = seeded_ema(m, signal)
    return {"vmacd": m, "vmacd_signal": s, "vmacd_hist": m - s}


def rsi_wilder(b, n=14):
    d = np.diff(b.close.to_numpy(float), prepend=np.nan)
    g, l = wilder(np.where(d > 0, d, 0.0), n, 1), wilder(np.where(d < 0, -d, 0.0), n, 1)
    with np.errstate(all="ignore"):
        return {"rsi_wilder": np.where(np.isnan(g), np.nan, np.where(l == 0, 100.0, 100 - 100 / (1 + g / l)))}


def atr_wilder(b, n=14):
    return {"atr_wilder": wilder(true_range(b), n)}


def _moves(b):
    up, down = b.high.diff(), -b.low.diff()
    plus = up.where((up > down) & (up > 0), 0.0)
    return plus, down.where((down > plus) & (down > 0), 0.0)


def adx(b, n=14):
    """Directional movement by exponential means; plus and minus indicators beside it."""
    plus, minus = _moves(b)
    tr = ewm(true_range(b), n)
    pdi, mdi = 100 * ewm(plus, n) / tr.replace(0, np.nan), 100 * ewm(minus, n) / tr.replace(0, np.nan)
    dx = 100 * (pdi - mdi).abs() / (pdi + mdi).replace(0, np.nan)
    return guarded(_all(adx=ewm(dx, n), plus_di=pdi, minus_di=mdi), 2 * n)


def adx_wilder(b, n=14):
    plus, minus = _moves(b)
    tr = wilder(true_range(b), n, 1)
    with np.errstate(all="ignore"):
        pdi, mdi = 100 * wilder(plus.to_numpy(float), n, 1) / tr, 100 * wilder(minus.to_numpy(float), n, 1) / tr
        dx = np.where(pdi + mdi > 0, 100 * np.abs(pdi - mdi) / (pdi + mdi), 0.0)
    return {"adx_wilder": wilder(dx, n, n)}


def psar(b, start=0.02, step=0.02, most=0.2):
    h, l, c = (b[x].to_numpy(float) for x in ("high", "low", "close"))
    out, side = np.full(len(c), np.nan), np.full(len(c), np.nan)
    if len(c):
        sar, bull, af, ep = c[0], True, start, h[0]
        out[0], side[0] = sar, 1
    for i in range(1, len(c)):
        sar += af * (ep - sar)
        if (bull and l[i] < sar) or (not bull and h[i] > sar):
            sar, bull, af, ep = ep, not bull, start, h[i] if not bull else l[i]
        else:
            better = max(ep, h[i]) if bull else min(ep, l[i])
            if better != ep:
                ep, af = better, min(af + step, most)
        out[i], side[i] = sar, 1 if bull else -1
    return guarded({"psar": out, "psar_side": side}, 2)


def supertrend(b, n=10, k=3.0):
    c, mid, a = b.close.to_numpy(float), ((b.high + b.low) / 2).to_numpy(float), wilder(true_range(b), n)
    line, side = np.full(len(c), np.nan), np.full(len(c), np.nan)
    upper = lower = np.nan
    way = 1
    for i in range(n - 1, len(c)):
        u, d = mid[i] + k * a[i], mid[i] - k * a[i]
        upper = u if np.isnan(upper) or u < upper or c[i - 1] > upper else upper
        lower = d if np.isnan(lower) or d > lower or c[i - 1] < lower else lower
        way = 1 if c[i] > upper else -1 if c[i] < lower else way
        line[i], side[i] = (lower if way == 1 else upper), way
    return guarded({"supertrend": line, "supertrend_side": side}, n + 1)


def keltner(b, n=20, m=10, k=2.0):
    mid, a = ewm(b.close, n), pd.Series(true_range(b)).rolling(m).mean()
    return guarded(_all(keltner_upper=mid + k * a, keltner_middle=mid, keltner_lower=mid - k * a), max(n, m))


def trix(b, n=15, signal=9):
    t = 100 * ewm(ewm(ewm(b.close, n), n), n).pct_change()
    return guarded(_all(trix=t, trix_signal=ewm(t, signal)), 3 * n + signal)


def dema_tema(b, n=20):
    e1 = ewm(b.close, n)
    e2 = ewm(e1, n)
    return {**guarded(_all(dema=2 * e1 - e2), 2 * n), **guarded(_all(tema=3 * e1 - 3 * e2 + ewm(e2, n)), 3 * n)}


def elder_ray(b, n=13):
    e = ewm(b.close, n)
    return guarded(_all(bull_power=b.high - e, bear_power=b.low - e), n)


def chaikin(b, fast=3, slow=10):
    span = (b.high - b.low).replace(0, np.nan)
    adl = ((((b.close - b.low) - (b.high - b.close)) / span).fillna(0) * b.volume).cumsum()
    return guarded(_all(chaikin=ewm(adl, fast) - ewm(adl, slow)), slow)


def force_index(b, n=13):
    return guarded(_all(force_index=ewm(b.close.diff() * b.volume, n)), n + 1)


def kdj(b, n=9, k=3, d=3):
    hh, ll = b.high.rolling(n).max(), b.low.rolling(n).min()
    rsv = (100 * (b.close - ll) / (hh - ll).replace(0, np.nan)).where(hh != ll, 50).where(hh.notna())
    kk = rsv.ewm(alpha=1 / k, adjust=False).mean()
    dd = kk.ewm(alpha=1 / d, adjust=False).mean()
    return _all(kdj_k=kk, kdj_d=dd, kdj_j=3 * kk - 2 * dd)


def klinger(b, fast=34, slow=55, signal=13):
    trend = np.sign((b.high + b.low + b.close).diff().fillna(0))
    force = b.volume * trend
    k = ewm(force, fast) - ewm(force, slow)
    return _all(klinger=k, klinger_signal=ewm(k, signal))


def zigzag(b, percent=5.0):
    """Pivots (looks ahead): the last extreme before a reversal by `percent`; null elsewhere."""
    c = b.close.to_numpy(float)
    out = np.full(len(c), np.nan)
    if len(c) < 3:
        return {"zigzag": out}
    at, way = 0, 0
    for i in range(1, len(c)):
        move = (c[i] - c[at]) / c[at] * 100 if c[at] else 0.0
        if way >= 0 and c[i] >= c[at] or way <= 0 and c[i] <= c[at] and way != 0:
            if way == 0 and move < percent:
                continue
            at, way = i, way or 1
        elif way >= 0 and move <= -percent:
            out[at], at, way = c[at], i, -1
        elif way < 0 and move >= percent:
            out[at], at, way = c[at], i, 1
    out[at] = c[at]
    return {"zigzag": out}


#: Recurrences by name, and the columns of each with the defaults.
RECURRENCES = {f.__name__: f for f in (ema, macd, vema, vmacd, rsi_wilder, atr_wilder, adx, adx_wilder, psar, supertrend, keltner, trix, dema_tema, elder_ray, chaikin, force_index, kdj, klinger, zigzag)}
LOOK_AHEAD = {"zigzag"}


def columns(name: str) -> list[str]:
    one = pd.DataFrame({c: [1.0, 1.0] for c in ("open", "high", "low", "close", "volume")})
    return list(RECURRENCES[name](one))


def apply(bars: DataFrame, wanted: dict[str, dict] | list[str]) -> DataFrame:
    """symbol, ts and the columns of the wanted recurrences ({name: parameters} or names)."""
    wanted = wanted if isinstance(wanted, dict) else {n: {} for n in wanted}
    cols = [c for n in wanted for c in columns(n)]

    def run(pdf):
        pdf = pdf.sort_values("ts", ignore_index=True)
        out = pdf[["symbol", "ts"]].copy()
        for n, params in wanted.items():
            for c, v in RECURRENCES[n](pdf, **params).items():
                out[c] = v
        return out

    schema = ", ".join(["symbol string", "ts timestamp", *[f"{c} double" for c in cols]])
    df = bars.groupBy("symbol").applyInPandas(run, schema)
    return df.selectExpr("symbol", "ts", *[f"nanvl({c}, NULL) AS {c}" for c in cols])
