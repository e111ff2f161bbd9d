"""Indicators that plain windows express; those that depend on their own last value are in recurrences."""

from __future__ import annotations

import math

from tidebar.operators.steps import Spec, cum, div, lag, lead, prior, roll, weighted

TP = "(high + low + close) / 3"
TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
FLAT = "CASE WHEN {b} = 0 THEN {v} ELSE {a} / nullif({b}, 0) END"


def ratio(a: str, b: str, flat: str) -> str:
    return FLAT.format(a=f"({a})", b=f"({b})", v=flat)


def sma(n=20, x="close"):
    return Spec(({"sma": roll("avg", x, n)},), ("sma",), n)


def rsi_sma(n=14):
    d = f"close - {lag('close')}"
    return Spec(({"dc": f"coalesce({d}, 0)"}, {"g": roll("avg", "greatest(dc, 0)", n), "l": roll("avg", "greatest(-dc, 0)", n)}, {"rsi": "CASE WHEN l = 0 AND g = 0 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END"}), ("rsi",), n + 1)


def bollinger(n=20, k=2.0, std="stddev_samp"):
    return Spec(({"middle": roll("avg", "close", n), "s": roll(std, "close", n)}, {"upper": f"middle + {k} * s", "lower": f"middle - {k} * s"}, {"percent_b": ratio("close - lower", "upper - lower", "0.5"), "width": f"{div('upper - lower', 'middle')} * 100"}), ("upper", "middle", "lower", "percent_b", "width"), n)


def atr_sma(n=14):
    return Spec(({"tr": TR}, {"atr": roll("avg", "tr", n)}), ("atr",), n + 1)


def stochastic(n=14, d=3, flat="NULL"):
    return Spec(({"hh": roll("max", "high", n), "ll": roll("min", "low", n)}, {"k": ratio("100 * (close - ll)", "hh - ll", flat)}, {"d": roll("avg", "k", d)}), ("k", "d"), n)


def extremes(n=20):
    return Spec(({"highest": roll("max", "high", n), "lowest": roll("min", "low", n)}, {"middle": "(highest + lowest) / 2"}), ("highest", "lowest", "middle"), n)


def change(n=12):
    return Spec(({"b": lag("close", n)}, {"roc": f"{div('close - b', 'b')} * 100", "momentum": "close - b"}), ("roc", "momentum"), n + 1)


def volatility(n=20):
    return Spec(({"r": f"{div('close', lag('close'))} - 1"}, {"volatility": f"{roll('stddev_samp', 'r', n)} * sqrt(252)"}), ("volatility",), n)


def volume_lines():
    r = f"{div('close', lag('close'))} - 1"
    return Spec(
        (
            {"dc": f"close - {lag('close')}", "r": r, "mfm": f"coalesce({div('(close - low) - (high - close)', 'high - low')}, 0)", "tpv": f"{TP} * volume"},
            {"obv": cum("sum", "CASE WHEN dc IS NULL THEN NULL ELSE sign(dc) * volume END"), "adl": cum("sum", "mfm * volume"), "pvt": cum("sum", "r * volume"), "vwap": div(cum("sum", "tpv"), cum("sum", "volume"))},
        ),
        ("obv", "adl", "pvt", "vwap"), 1, 1,
    )


def volume_index(log=False):
    """Negative and positive volume index from 1000; or their logarithms."""
    part = lambda sign: cum("sum", f"CASE WHEN volume {sign} pv AND 1 + r > 0 THEN ln(1 + r) ELSE 0 END")
    whole = (lambda x: x) if log else (lambda x: f"1000 * exp({x})")
    return Spec(({"r": f"{div('close', lag('close'))} - 1", "pv": lag("volume")}, {"nvi": whole(part("<")), "pvi": whole(part(">"))}), ("nvi", "pvi"), 2)


def williams_r(n=14):
    return Spec(({"hh": roll("max", "high", n), "ll": roll("min", "low", n)}, {"williams_r": f"-100 * {div('hh - close', 'hh - ll')}"}), ("williams_r",), n)


def cci(n=20):
    lags = [("tp" if i == 0 else lag("tp", i)) for i in range(n)]
    mad = " + ".join(f"abs({x} - m)" for x in lags)
    return Spec(({"tp": TP}, {"m": roll("avg", "tp", n)}, {"mad": f"({mad}) / {n}"}, {"cci": div("tp - m", "0.015 * mad")}), ("cci",), n)


def mfi(n=14):
    return Spec(({"tp": TP}, {"ptp": lag("tp")}, {"pos": f"CASE WHEN tp > ptp THEN tp * volume ELSE 0 END", "neg": "CASE WHEN tp < ptp THEN tp * volume ELSE 0 END"}, {"p": roll("sum", "pos", n), "q": roll("sum", "neg", n)}, {"mfi": "CASE WHEN q = 0 AND p = 0 THEN NULL WHEN q = 0 THEN 100 ELSE 100 - 100 / (1 + p / nullif(q, 0)) END"}), ("mfi",), n + 1)


def ichimoku(a=9, b=26, c=52):
    mid = lambda n: f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2"
    return Spec(({"tenkan": mid(a), "kijun": mid(b), "wide": mid(c)}, {"senkou_a": lag("(tenkan + kijun) / 2", b), "senkou_b": lag("wide", b), "chikou": lead("close", b)}), ("tenkan", "kijun", "senkou_a", "senkou_b", "chikou"), c)


def dpo(n=20):
    return Spec(({"dpo": f"{lag('close', n // 2 + 1)} - {roll('avg', 'close', n)}"},), ("dpo",), n)


def cmo(n=14):
    return Spec(({"d": f"coalesce(close - {lag('close')}, 0)"}, {"g": roll("sum", "greatest(d, 0)", n), "l": roll("sum", "greatest(-d, 0)", n)}, {"cmo": f"100 * {div('g - l', 'g + l')}"}), ("cmo",), n + 1)


def ulcer(n=14):
    return Spec(({"top": roll("max", "close", n)}, {"dd": f"100 * {div('close - top', 'top')}"}, {"ulcer": f"sqrt({roll('avg', 'dd * dd', n)})"}), ("ulcer",), n)


def emv(n=14):
    return Spec(({"move": f"(high + low) / 2 - {lag('(high + low) / 2')}", "box": div("volume / 1e8", "high - low")}, {"e": div("move", "box")}, {"emv": roll("avg", "e", n)}), ("emv",), n + 1, 0)


def vroc(n=14):
    return Spec(({"b": lag("volume", n)}, {"vroc": f"{div('volume - b', 'b')} * 100"}), ("vroc",), n + 1)


def wma(n=20, x="close"):
    return Spec(({"wma": weighted(x, [i + 1.0 for i in range(n)])},), ("wma",), n)


def hma(n=20):
    w = lambda m: [i + 1.0 for i in range(m)]
    return Spec(({"half": weighted("close", w(n // 2)), "whole": weighted("close", w(n))}, {"raw": "2 * half - whole"}, {"hma": weighted("raw", w(int(math.sqrt(n))))}), ("hma",), n)


def alma(n=20, sigma=6.0, offset=0.85):
    m, s = offset * (n - 1), n / sigma
    return Spec(({"alma": weighted("close", [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(n)])},), ("alma",), n)


def vwma(n=20):
    return Spec(({"vwma": div(roll("sum", "close * volume", n), roll("sum", "volume", n))},), ("vwma",), n)


def twap(n=20):
    return Spec(({"twap": roll("avg", "(open + high + low + close) / 4", n)},), ("twap",), n)


def pivot_points():
    return Spec(({"h": lag("high"), "l": lag("low"), "c": lag("close")}, {"p": "(h + l + c) / 3"}, {"r1": "2 * p - l", "s1": "2 * p - h", "r2": "p + (h - l)", "s2": "p - (h - l)", "r3": "h + 2 * (p - l)", "s3": "l - 2 * (h - p)"}), ("p", "r1", "r2", "r3", "s1", "s2", "s3"), 2)


def fibonacci(n=50):
    levels = {f"f{int(x * 1000)}": f"lo + {x} * (hi - lo)" for x in (0.0, 0.236, 0.382, 0.5, 0.618)}
    return Spec(({"hi": roll("max", "high", n), "lo": roll("min", "low", n)}, levels), tuple(levels), n)


def stochastic_rsi(n=14, m=14, k=3, d=3):
    r = rsi_sma(n)
    return Spec((*r.steps, {"hi": roll("max", "rsi", m), "lo": roll("min", "rsi", m)}, {"raw": ratio("100 * (rsi - lo)", "hi - lo", "50")}, {"k": roll("avg", "raw", k)}, {"d": roll("avg", "k", d)}), ("k", "d"), n + 1)


def awesome(a=5, b=34):
    return Spec(({"awesome": f"{roll('avg', '(high + low) / 2', a)} - {roll('avg', '(high + low) / 2', b)}"},), ("awesome",), b)


def ultimate(a=7, b=14, c=28):
    part = lambda n: div(roll("sum", "bp", n), roll("sum", "tr", n))
    return Spec(({"pc": lag("close")}, {"bp": "CASE WHEN pc IS NULL THEN 0 ELSE close - least(low, pc) END", "tr": "CASE WHEN pc IS NULL THEN 0 ELSE greatest(high, pc) - least(low, pc) END"}, {"ultimate": f"100 * (4 * {part(a)} + 2 * {part(b)} + {part(c)}) / 7"}), ("ultimate",), c + 1)


def linear_regression(n=20):
    x = f"CAST(rn AS DOUBLE)"
    fit = lambda f: f"CASE WHEN count(close) OVER w{n} = {n} THEN {f}(close, {x}) OVER w{n} END".replace(f"OVER w{n}", f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")
    return Spec(({"slope": fit("regr_slope"), "base": fit("regr_intercept"), "r2": fit("regr_r2")}, {"fitted": "base + slope * rn"}), ("fitted", "slope", "r2"), n, 3)


def bar_shapes():
    body = "abs(close - open)"
    return Spec(({"typical": TP, "median": "(high + low) / 2", "weighted": "(high + low + 2 * close) / 4", "span": "high - low", "body": body, "upper_shadow": "high - greatest(open, close)", "lower_shadow": "least(open, close) - low",
                  "bullish": "CAST(close > open AS INT)", "bearish": "CAST(close < open AS INT)", "doji": f"CAST(CASE WHEN high = low THEN TRUE ELSE {body} / nullif(high - low, 0) < 0.1 END AS INT)", "change": "CASE WHEN open = 0 THEN 0 ELSE (close - open) / nullif(open, 0) * 100 END"},),
                ("typical", "median", "weighted", "span", "body", "upper_shadow", "lower_shadow", "bullish", "bearish", "doji", "change"))


def rolling_performance(n=60, rf=0.035):
    return Spec(({"r": f"{div('close', lag('close'))} - 1"}, {"m": roll("avg", "r", n), "s": roll("stddev_samp", "r", n), "neg": roll("stddev_samp", "least(r, 0)", n)}, {"sharpe": f"(m * 252 - {rf}) / nullif(s * sqrt(252), 0)", "sortino": f"(m * 252 - {rf}) / nullif(neg * sqrt(252), 0)", "vol": "s * sqrt(252)"}), ("sharpe", "sortino", "vol"), n, 3)


def zscore(n=20):
    return Spec(({"m": roll("avg", "close", n), "s": roll("stddev_samp", "close", n)}, {"z": div("close - m", "s")}), ("z",), n)


def drawdown():
    return Spec(({"top": cum("max", "close")}, {"drawdown": div("close - top", "top")}), ("top", "drawdown"))


#: Indicators by name, with the defaults.
INDICATORS = {f.__name__: f for f in (sma, rsi_sma, bollinger, atr_sma, stochastic, extremes, change, volatility, volume_lines, volume_index, williams_r, cci, mfi, ichimoku, dpo, cmo, ulcer, emv, vroc, wma, hma, alma, vwma, twap, pivot_points, fibonacci, stochastic_rsi, awesome, ultimate, linear_regression, bar_shapes, rolling_performance, zscore, drawdown)}


# Signals: 1 buy, -1 sell, 0 none; null operands give 0.
def cross(f: str, s: str) -> str:
    return f"CASE WHEN {lag(f)} <= {lag(s)} AND {f} > {s} THEN 1 WHEN {lag(f)} >= {lag(s)} AND {f} < {s} THEN -1 ELSE 0 END"


def golden_cross(fast=10, slow=30):
    return Spec(({"f": roll("avg", "close", fast), "s": roll("avg", "close", slow)}, {"signal": cross("f", "s")}), ("signal",))


def rsi_signal(n=14, low=30, high=70):
    r = rsi_sma(n)
    return Spec((*r.steps, {"signal": f"CASE WHEN {lag('rsi')} <= {low} AND rsi > {low} THEN 1 WHEN {lag('rsi')} >= {high} AND rsi < {high} THEN -1 ELSE 0 END"}), ("signal",))


def bollinger_signal(n=20, k=2.0):
    b = bollinger(n, k, "stddev_pop")
    return Spec((*b.steps[:2], {"signal": f"CASE WHEN close >= upper THEN -1 WHEN {lag('close')} <= {lag('lower')} AND close > lower THEN 1 ELSE 0 END"}), ("signal",))


def breakout_signal(n=20):
    return Spec(({"hh": prior("max", "high", n), "ll": prior("min", "low", n)}, {"signal": "CASE WHEN close > hh THEN 1 WHEN close < ll THEN -1 ELSE 0 END"}), ("signal",))


def momentum_signal(fast=10, slow=30):
    return Spec(({"f": f"close - {lag('close', fast)}", "s": f"close - {lag('close', slow)}"}, {"signal": cross("f", "s")}), ("signal",))


def trend_filter(adx: str = "adx", n: int = 50, threshold: float = 25.0):
    """Of bars that carry `signal` and a directional index: signals in a strong trend, on the right side of the mean."""
    keep = f"{adx} >= {threshold} AND ((signal = 1 AND close > m) OR (signal = -1 AND close < m))"
    return Spec(({"m": roll("avg", "close", n)}, {"filtered": f"CASE WHEN {keep} THEN signal ELSE 0 END"}), ("filtered",))


SIGNALS = {f.__name__: f for f in (golden_cross, rsi_signal, bollinger_signal, breakout_signal, momentum_signal)}
