"""Preset strategies: columns, a buy and a sell rule each, and the shared fold.

Rules look back with lag() only; channels are those of the bars before. Columns come from window steps and recurrences."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.operators import recurrences, simulate
from tidebar.operators.indicators import atr_sma, bollinger, cci, rsi_sma, stochastic, williams_r
from tidebar.operators.simulate import Rules
from tidebar.operators.steps import ROW, lag, prior, roll


@dataclass(frozen=True)
class Preset:
    buy: str
    sell: str
    steps: tuple[dict[str, str], ...] = ()
    needs: dict[str, dict] | None = None
    stop: float = 0.0
    take: float = 0.0
    trail: float = 0.0


def up(a: str, b: str) -> str:
    return f"{lag(a)} <= {lag(b)} AND {a} > {b}"


def down(a: str, b: str) -> str:
    return f"{lag(a)} >= {lag(b)} AND {a} < {b}"


def over(a: str, level: float) -> str:
    return f"{lag(a)} <= {level} AND {a} > {level}"


def under(a: str, level: float) -> str:
    return f"{lag(a)} >= {level} AND {a} < {level}"


def means(**cols: int) -> dict[str, str]:
    return {k: roll("avg", "close", n) for k, n in cols.items()}


RSI, BANDS, ATR = rsi_sma(14).steps, bollinger(20).steps[:2], atr_sma(14).steps
MOM = {"mom": f"close - {lag('close', 10)}"}

PRESETS: dict[str, Preset] = {
    "goldenCross": Preset(up("f", "s"), down("f", "s"), (means(f=10, s=30),)),
    "rsiOversold": Preset(over("rsi", 30), under("rsi", 70), RSI),
    "bollingerBreakout": Preset(up("close", "lower"), "close > upper", BANDS),
    "macdCross": Preset(up("macd", "macd_signal"), down("macd", "macd_signal"), (), {"macd": {}}),
    "breakout": Preset("close > hh", "close < ll", ({"hh": prior("max", "high", 20), "ll": prior("min", "low", 20)},)),
    "meanReversion": Preset("close < lower", "close > upper", BANDS, stop=5),
    "trendFollowing": Preset(f"{up('f', 's')} AND adx >= 25", down("f", "s"), (means(f=10, s=30),), {"adx": {}}, trail=10),
    "emaCross": Preset(up("e1", "e2"), down("e1", "e2"), (), {"ema:e1": {"n": 12}, "ema:e2": {"n": 26}}),
    "tripleScreen": Preset("close > m1 AND rsi < 30 AND close > m2", "close < m1 OR rsi > 70", (*RSI, means(m1=50, m2=20)), stop=5),
    "dualMomentum": Preset("close > old AND roc > 0", "roc < 0", ({"old": lag("close", 252), "roc": f"close / nullif({lag('close', 21)}, 0) - 1"},)),
    "momentumCross": Preset(up("a", "b"), down("a", "b"), ({"a": f"close - {lag('close', 10)}", "b": f"close - {lag('close', 30)}"},)),
    "rocBreakout": Preset("roc > 5", "roc < -5", ({"roc": f"(close / nullif({lag('close', 14)}, 0) - 1) * 100"},)),
    "stochasticCross": Preset(f"{up('k', 'd')} AND k < 20", f"{down('k', 'd')} AND k > 80", stochastic(14, 3).steps),
    "williamsReversal": Preset(over("williams_r", -80), under("williams_r", -20), williams_r(14).steps),
    "cciBreakout": Preset(over("cci", 100), under("cci", -100), cci(20).steps),
    "rsiDivergence": Preset(f"rsi < 30 AND {over('mom', 0)}", "rsi > 70 OR mom < 0", (*RSI, MOM)),
    "volatilityBreakout": Preset("close > pc + 2 * pa", "close < pc - 2 * pa", (*ATR, {"pc": lag("close"), "pa": lag("atr")})),
    "keltnerChannel": Preset("close > e1 + 2 * atr", "close < e1 - 2 * atr", ATR, {"ema:e1": {"n": 20}}),
    "bollingerSqueeze": Preset("(upper - lower) / nullif(middle, 0) < 0.04 AND close > upper", "close < middle", BANDS),
    "superTrend": Preset(over("supertrend_side", 0), under("supertrend_side", 0), (), {"supertrend": {}}),
    "ichimokuCloud": Preset(f"{up('ten', 'kij')} AND close > greatest(sa, sb)", "ten < kij OR close < least(sa, sb)", ({k: f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2" for k, n in (("ten", 9), ("kij", 26), ("wide", 52))}, {"sa": lag("(ten + kij) / 2", 26), "sb": lag("wide", 26)})),
    "parabolicSar": Preset(over("psar_side", 0), under("psar_side", 0), (), {"psar": {}}),
    "donchianBreakout": Preset("close > hh", "close < ll", ({"hh": prior("max", "high", 20), "ll": prior("min", "low", 10)},)),
    "tripleEma": Preset(f"e2 > e3 AND {up('e1', 'e2')}", f"e2 < e3 AND {down('e1', 'e2')}", (), {"ema:e1": {"n": 5}, "ema:e2": {"n": 13}, "ema:e3": {"n": 34}}),
    "macdRsiCombo": Preset(f"{up('macd', 'macd_signal')} AND rsi < 60", f"{down('macd', 'macd_signal')} AND rsi > 40", RSI, {"macd": {}}),
    "trendMomentum": Preset("close > m1 AND adx >= 25 AND rsi < 60", "close < m1 OR (adx < 25 AND rsi > 60)", (*RSI, means(m1=50)), {"adx": {}}),
    "bollingerRsi": Preset("close <= lower AND rsi < 30", "close >= upper AND rsi > 70", (*RSI, *BANDS)),
    "gapTrading": Preset("open >= pc * 1.02", "open <= pc * 0.98 OR close < pc", ({"pc": lag("close")},), stop=3),
    "pyramiding": Preset(f"close > m1 AND m1 > m2 AND m2 > m3 AND {lag('m1')} <= {lag('m2')}", "close < m3", (means(m1=10, m2=20, m3=30),), trail=10),
    "swingTrading": Preset("rsi < 30 AND atr / nullif(close, 0) * 100 < 10 AND close > m1", f"rsi > 70 OR close < {lag('close')} - 2 * atr", (*RSI, *ATR, means(m1=20))),
    "scalpingMomentum": Preset(f"{up('close', 'e1')} AND {over('rsi', 50)}", "close < e1 OR rsi < 50", rsi_sma(7).steps, {"ema:e1": {"n": 5}}, stop=2, take=3),
    "buyAndHold": Preset("TRUE", "FALSE"),
    "dollarCostAverage": Preset("(rn - 1) % 21 = 0", "FALSE"),
}

#: Names in Korean. Fixed values.
KOREAN = {"골든크로스": "goldenCross", "RSI과매도": "rsiOversold", "볼린저돌파": "bollingerBreakout", "MACD크로스": "macdCross", "돌파": "breakout", "평균회귀": "meanReversion", "추세추종": "trendFollowing", "삼중스크린": "tripleScreen", "듀얼모멘텀": "dualMomentum", "슈퍼트렌드": "superTrend", "일목균형표": "ichimokuCloud", "매수후보유": "buyAndHold"}


def with_signals(bars: DataFrame, p: Preset) -> DataFrame:
    """bars with `signal`: 1 where the buy rule holds, -1 where the sell rule does (and the buy rule doesn't); unknown is neither."""
    df = bars
    for need, params in (p.needs or {}).items():
        name, _, alias = need.partition(":")
        cols = recurrences.apply(bars, {name: params})
        df = df.join(cols.withColumnRenamed(name, alias) if alias else cols, ["symbol", "ts"])
    for step in (ROW, *p.steps):
        df = df.selectExpr("*", *[f"{e} AS {c}" for c, e in step.items()])
    df = df.selectExpr("*", f"coalesce({p.buy}, FALSE) AS buy", f"coalesce({p.sell}, FALSE) AS sell")
    return df.selectExpr(*bars.columns, "CAST(CASE WHEN buy THEN 1 WHEN sell THEN -1 ELSE 0 END AS INT) AS signal")


def run(bars: DataFrame, name: str, rules: Rules = Rules(fill="open")) -> DataFrame:
    """Metrics a symbol of a preset (its name, or the Korean one), orders filled on the next open."""
    p = PRESETS[KOREAN.get(name, name)]
    return simulate.backtest(with_signals(bars, p), None, replace(rules, stop=p.stop, take=p.take, trail=p.trail))


class Rule:
    """Conditions that users build: buy and sell Columns joined by OR, stops, then run().

    Unknown operands count as false. `quick(bars).buy_when(rsi < 30).sell_when(rsi > 70).stop_loss(5).run()`."""

    def __init__(self, bars: DataFrame, rules: Rules = Rules(fill="open")):
        self.bars, self.rules, self.buys, self.sells = bars, rules, [], []

    def buy_when(self, cond: Column) -> Rule:
        self.buys.append(F.coalesce(cond, F.lit(False)))
        return self

    def sell_when(self, cond: Column) -> Rule:
        self.sells.append(F.coalesce(cond, F.lit(False)))
        return self

    def stop_loss(self, percent: float) -> Rule:
        self.rules = replace(self.rules, stop=percent)
        return self

    def take_profit(self, percent: float) -> Rule:
        self.rules = replace(self.rules, take=percent)
        return self

    def trailing_stop(self, percent: float) -> Rule:
        self.rules = replace(self.rules, trail=percent)
        return self

    def signals(self) -> DataFrame:
        any_of = lambda cs: F.exists(F.array(*cs), lambda x: x) if cs else F.lit(False)
        return self.bars.withColumn("signal", F.when(any_of(self.buys), 1).when(any_of(self.sells), -1).otherwise(0))

    def run(self) -> DataFrame:
        return simulate.backtest(self.signals(), None, self.rules)


quick = Rule
