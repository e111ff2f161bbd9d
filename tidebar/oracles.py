"""DuckDB SQL for the simulations: a recursive query walks the bars, plain aggregates judge the equity.

Nothing of it is shared with the operators but the presets' conditions, which are texts."""

from __future__ import annotations

from tidebar.operators.simulate import Rules
from tidebar.operators.steps import NUDGE, ROW
from tidebar.plans.metrics import NUDGE as metrics_nudge
from tidebar.plans.presets import Preset


def _num(x: float) -> str:
    return f"{x!r}::DOUBLE"


def averages(spans: dict[str, int]) -> str:
    """Recursive tables `x` with exponential means (name: span) of b.close, from the first close on: symbol, rn, names."""
    first = ", ".join(f"close AS {c}" for c in spans)
    step = ", ".join(f"b.close * {_num(2 / (n + 1))} + x.{c} * {_num((n - 1) / (n + 1))} AS {c}" for c, n in spans.items())
    return f"x AS (SELECT symbol, rn, {first} FROM n WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, {step} FROM x JOIN n b ON b.symbol = x.symbol AND b.rn = x.rn + 1)"


MACD = f"""x AS (SELECT symbol, rn, close AS f, close AS s, 0e0 AS g FROM n WHERE rn = 1 UNION ALL
    SELECT symbol, rn, f, s, (f - s) * {_num(2 / 10)} + g * {_num(8 / 10)} FROM (SELECT b.symbol, b.rn, b.close * {_num(2 / 13)} + x.f * {_num(11 / 13)} AS f, b.close * {_num(2 / 27)} + x.s * {_num(25 / 27)} AS s, x.g FROM x JOIN n b ON b.symbol = x.symbol AND b.rn = x.rn + 1))"""


def _numbered(bars: str) -> str:
    return f"n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM ({bars}))"


def preset_signals(bars: str, p: Preset) -> str | None:
    """Tables up to b (with signal) of a preset; None where it needs a recurrence that isn't written here."""
    tables, source = [_numbered(bars)], "n"
    needs = p.needs or {}
    if needs and set(needs) <= {"macd"}:
        tables.append(MACD)
        source = "(SELECT n.*, CASE WHEN n.rn >= 35 THEN f - s END AS macd, CASE WHEN n.rn >= 35 THEN g END AS macd_signal FROM n JOIN x USING (symbol, rn))"
    elif needs and all(k.startswith("ema:") for k in needs):
        spans = {k[4:]: v["n"] for k, v in needs.items()}
        tables.append(averages(spans))
        source = f"(SELECT n.*, {', '.join(f'CASE WHEN n.rn >= {k} THEN x.{c} END AS {c}' for c, k in spans.items())} FROM n JOIN x USING (symbol, rn))"
    elif needs:
        return None
    q = f"SELECT * FROM {source}"
    for step in p.steps:
        q = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in step.items() if c not in ROW)} FROM ({q})"
    q = f"SELECT *, coalesce({p.buy}, FALSE) AS is_buy, coalesce({p.sell}, FALSE) AS is_sell FROM ({q})"
    tables.append(f"b AS MATERIALIZED (SELECT symbol, ts, rn, open, high, close, CASE WHEN is_buy THEN 1 WHEN is_sell THEN -1 ELSE 0 END AS signal FROM ({q}))")
    return ", ".join(tables)


def _cross(a: str, b: str, way: int = 0) -> str:
    up = f"lag({a}) OVER w <= lag({b}) OVER w AND {a} > {b}"
    down = f"lag({a}) OVER w >= lag({b}) OVER w AND {a} < {b}"
    return {1: up, -1: down, 0: f"CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END"}[way]


_MEAN = "CASE WHEN rn >= {n} THEN (SELECT avg(p.{c}) FROM {t} p WHERE p.symbol = {t}1.symbol AND p.rn BETWEEN {t}1.rn - {n} + 1 AND {t}1.rn) END"
_SELL_FIRST = "SELECT symbol, ts, rn, open, high, close, CASE WHEN {down} THEN -1 WHEN {up} THEN 1 ELSE 0 END AS signal FROM ({q}) WINDOW w AS (PARTITION BY symbol ORDER BY rn)"


def _last(n: int, agg: str, c: str, shift: int = 0) -> str:
    return f"CASE WHEN rn >= {n + shift} THEN {agg}({c}) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n + shift - 1} PRECEDING AND {shift} PRECEDING) END"


def strategy_signals(bars: str, name: str) -> str:
    """Tables up to b (with signal) of the vectorized strategies with their defaults."""
    tables = [_numbered(bars)]
    if name == "goldenCross":
        q = f"SELECT symbol, ts, rn, open, high, close, {_cross('f', 's')} AS signal FROM (SELECT *, {_last(10, 'avg', 'close')} AS f, {_last(30, 'avg', 'close')} AS s FROM n) WINDOW w AS (PARTITION BY symbol ORDER BY rn)"
    elif name == "rsi":
        d = "SELECT *, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY rn), 0) AS d FROM n"
        r = f"SELECT *, {_last(14, 'avg', 'greatest(d, 0)')} AS g, {_last(14, 'avg', 'greatest(-d, 0)')} AS l FROM ({d})"
        r = f"SELECT *, CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS r FROM ({r})"
        q = f"SELECT symbol, ts, rn, open, high, close, CASE WHEN lag(r) OVER w <= 30 AND r > 30 THEN 1 WHEN lag(r) OVER w >= 70 AND r < 70 THEN -1 ELSE 0 END AS signal FROM ({r}) WINDOW w AS (PARTITION BY symbol ORDER BY rn)"
    elif name == "bollinger":
        m = f"SELECT *, {_last(20, 'avg', 'close')} AS m, {_last(20, 'stddev_pop', 'close')} AS s FROM n"
        q = _SELL_FIRST.format(down="close >= m + 2 * s", up="lag(close) OVER w <= lag(m - 2 * s) OVER w AND close > m - 2 * s", q=m)
    elif name == "breakout":
        m = f"SELECT *, {_last(20, 'max', 'high', 1)} AS hh, {_last(20, 'min', 'low', 1)} AS ll FROM n"
        q = f"SELECT symbol, ts, rn, open, high, close, CASE WHEN close > hh THEN 1 WHEN close < ll THEN -1 ELSE 0 END AS signal FROM ({m})"
    else:  # macd
        tables.append(MACD)
        q = f"SELECT symbol, ts, rn, open, high, close, {_cross('m', 'g')} AS signal FROM (SELECT n.*, f - s AS m, g FROM n JOIN x USING (symbol, rn)) WINDOW w AS (PARTITION BY symbol ORDER BY rn)"
    return ", ".join([*tables, f"b AS MATERIALIZED ({q})"])


_STATE = "symbol, rn, ts, open, high, close, signal, want, cash, shares, entry, top, bought, paid, sold, got, lot, pnl"


def _sell(q: str, when: str, price: str, r: Rules) -> str:
    got = f"shares * {price} * {_num(1 - r.slippage)}"
    fee = f"{got} * {_num(r.commission + r.tax)}"
    do = lambda then, c: f"CASE WHEN go THEN {then} ELSE {c} END AS {c}"
    return f"""SELECT symbol, rn, ts, open, high, close, signal, want, {do(f'cash + {got} - {fee}', 'cash')}, {do('0e0', 'shares')}, entry, top, bought, paid, {do('1', 'sold')}, {do(f'{price} * {_num(1 - r.slippage)}', 'got')}, {do('shares', 'lot')}, {do(f'{got} - {fee} - shares * entry', 'pnl')}
        FROM (SELECT *, coalesce(({when}) AND shares > 0, FALSE) AS go FROM ({q}))"""


def _buy(q: str, when: str, price: str, r: Rules) -> str:
    cost = f"q * {price} * {_num(1 + r.slippage)}"
    do = lambda then, c: f"CASE WHEN go THEN {then} ELSE {c} END AS {c}"
    return f"""SELECT symbol, rn, ts, open, high, close, signal, want, {do(f'cash - {cost} * {_num(1 + r.commission)}', 'cash')}, {do('q', 'shares')}, {do(f'{price} * {_num(1 + r.slippage)}', 'entry')}, {do(price, 'top')}, {do('1', 'bought')}, {do(f'{price} * {_num(1 + r.slippage)}', 'paid')}, sold, got, lot, pnl
        FROM (SELECT *, coalesce(({when}) AND shares = 0 AND q > 0 AND {cost} * {_num(1 + r.commission)} <= cash, FALSE) AS go FROM (SELECT *, floor(cash * {_num(r.invest)} / ({price} * {_num(1 + r.slippage)})) AS q FROM ({q})))"""


def run(signals: str, rules: Rules) -> str:
    """Tables up to run: a row a bar with the state after it, equity, and what was bought and sold at it."""
    q = "SELECT b.symbol, b.rn, b.ts, b.open, b.high, b.close, b.signal, run.want, run.cash, run.shares, run.entry, run.top, 0 AS bought, NULL::DOUBLE AS paid, 0 AS sold, NULL::DOUBLE AS got, NULL::DOUBLE AS lot, NULL::DOUBLE AS pnl FROM run JOIN b ON b.symbol = run.symbol AND b.rn = run.rn + 1"
    if rules.fill == "open":
        q = _buy(_sell(q, "want = -1", "open", rules), "want = 1", "open", rules)
    exits = [f"(close / entry - 1) * 100 <= {_num(-rules.stop)}"] if rules.stop else []
    exits += [f"(close / entry - 1) * 100 >= {_num(rules.take)}"] if rules.take else []
    exits += [f"close <= top * {_num(1 - rules.trail / 100)}"] if rules.trail else []
    if exits:
        q = f"SELECT * REPLACE (CASE WHEN shares > 0 THEN greatest(top, high) ELSE top END AS top) FROM ({q})"
        q = _sell(q, " OR ".join(exits), "close", rules)
    if rules.fill == "close":
        q = _buy(_sell(q, "signal = -1", "close", rules), "signal = 1", "close", rules)
    start = f"SELECT DISTINCT symbol, 0::BIGINT AS rn, NULL::TIMESTAMP AS ts, 0 AS want, {_num(rules.cash)} AS cash, 0e0 AS shares, 0e0 AS entry, 0e0 AS top, NULL::DOUBLE AS equity, 0 AS bought, NULL::DOUBLE AS paid, 0 AS sold, NULL::DOUBLE AS got, NULL::DOUBLE AS lot, NULL::DOUBLE AS pnl FROM b"
    return f"{signals}, run AS ({start} UNION ALL SELECT symbol, rn, ts, signal, cash, shares, entry, top, cash + shares * close, bought, paid, sold, got, lot, pnl FROM ({q}))"


def metrics(signals: str, rules: Rules) -> str:
    e = f"SELECT *, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS r, max(equity) OVER (PARTITION BY symbol ORDER BY rn) AS peak FROM run WHERE rn >= 1"
    d = f"SELECT *, (equity - peak) / peak AS dd, sum(CASE WHEN equity >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY rn) AS spell FROM ({e})"
    longest = "SELECT symbol, max(k) AS mdd_duration FROM (SELECT symbol, spell, count(*) FILTER (equity < peak) AS k FROM d GROUP BY symbol, spell) GROUP BY symbol"
    a = f"""SELECT symbol, (arg_max(equity, rn) / {_num(rules.cash)} - 1) * 100 AS total, count(*) AS n, coalesce(stddev_pop(r), 0) AS std, coalesce(avg(r), 0) AS mean, coalesce(stddev_samp(r) FILTER (r < 0), 0) * sqrt(252) * 100 AS down, min(dd) * 100 AS mdd, sum(sold) AS sells, sum(bought) AS buys,
        count(*) FILTER (pnl > 0) AS wins, coalesce(sum(greatest(pnl, 0)), 0) AS won, coalesce(sum(greatest(-pnl, 0)), 0) AS lost, arg_max(equity, rn) AS final_equity FROM d GROUP BY symbol"""
    a = f"SELECT *, sign(1 + total / 100) * pow(abs(1 + total / 100), 252 / n) * 100 - 100 AS annual FROM ({a})"
    out = {
        "total_return": "total", "annual_return": "annual", "volatility": "std * sqrt(252) * 100", "sharpe": "CASE WHEN std > 1e-15 THEN (mean - 0.035::DOUBLE / 252) / std * sqrt(252) ELSE 0 END",
        "sortino": "CASE WHEN down > 1e-12 THEN (annual - 3.5) / down ELSE 0 END", "calmar": "CASE WHEN mdd < 0 THEN annual / -mdd ELSE 0 END", "max_drawdown": "mdd", "mdd_duration": "mdd_duration", "win_rate": "CASE WHEN sells > 0 THEN wins * 100 / sells ELSE 0 END",
        "profit_factor": "CASE WHEN lost > 0 THEN won / lost END", "total_trades": "buys + sells", "final_equity": "final_equity",
    }
    return f"WITH RECURSIVE {run(signals, rules)}, d AS ({d}) SELECT symbol, {', '.join(f'round(CAST({e} AS DOUBLE), 4) + 0e0 AS {c}' for c, e in out.items())} FROM ({a}) JOIN ({longest}) USING (symbol)"


def equity(signals: str, rules: Rules) -> str:
    return f"WITH RECURSIVE {run(signals, rules)} SELECT symbol, ts, equity FROM run WHERE rn >= 1"


def trades(signals: str, rules: Rules) -> str:
    return f"""WITH RECURSIVE {run(signals, rules)} SELECT symbol, ts, 'BUY' AS side, paid AS price, shares AS quantity, 0e0 AS pnl FROM run WHERE bought = 1
        UNION ALL SELECT symbol, ts, 'SELL', got, lot, pnl FROM run WHERE sold = 1"""


def walk(bars: str, prepared: dict[str, str], first: dict[str, str], levels: list[dict[str, str]], out: dict[str, str]) -> str:
    """A recurrence: `first` gives the state at a symbol's first bar, `levels` the next one from the bar's columns and the
    state before (p_<name>), level by level; `out` the rounded results. prepared: columns over windows of the bars."""
    state = list(first)
    q = f"SELECT b.*, {', '.join(f'x.{c} AS p_{c}' for c in state)} FROM x JOIN n b ON b.symbol = x.symbol AND b.rn = x.rn + 1"
    for level in levels:
        q = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in level.items())} FROM ({q})"
    n = f"SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc FROM ({bars}) WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
    n = f"SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE WHEN high - lag(high) OVER w > lag(low) OVER w - low AND high > lag(high) OVER w THEN high - lag(high) OVER w ELSE 0 END AS plus, lag(low) OVER w - low AS fall FROM ({n}) WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
    n = f"SELECT *, CASE WHEN fall > plus AND fall > 0 THEN fall ELSE 0 END AS minus FROM ({n})"
    if prepared:
        n = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in prepared.items())} FROM ({n}) WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
    results = ", ".join(f"round(CAST({e} AS DOUBLE) + {NUDGE}, 4) + 0e0 AS {c}" for c, e in out.items())
    return f"""WITH RECURSIVE n AS MATERIALIZED ({n}), x AS (SELECT symbol, rn, {', '.join(f'CAST({e} AS DOUBLE) AS {c}' for c, e in first.items())} FROM n WHERE rn = 1
        UNION ALL SELECT symbol, rn, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in state)} FROM ({q})) SELECT symbol, ts, {results} FROM n JOIN x USING (symbol, rn)"""


def _ema(c: str, value: str, n: int) -> str:
    return f"{_num(2 / (n + 1))} * ({value}) + {_num((n - 1) / (n + 1))} * p_{c}"


def _from(c: str, value: str, n: int) -> str:
    """An exponential mean that begins where its value is known."""
    return f"CASE WHEN ({value}) IS NULL THEN p_{c} WHEN p_{c} IS NULL THEN {value} ELSE {_ema(c, value, n)} END"


def _wild(c: str, value: str, n: int, at: int, seed: str) -> str:
    """Wilder's mean, from the seed at bar `at`."""
    return f"CASE WHEN rn = {at} THEN {seed} WHEN rn > {at} THEN (p_{c} * {n - 1} + {value}) / {n} END"


def _seeded(c: str, n: int) -> str:
    return f"CASE WHEN rn = {n} THEN m{n} WHEN rn > {n} THEN {_ema(c, 'close', n)} END"


def _after(guard: int, **out: str) -> dict[str, str]:
    return {c: f"CASE WHEN rn >= {guard} THEN {e} END" for c, e in out.items()}


def _mean(c: str, n: int) -> str:
    return f"avg({c}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_RSV = "CASE WHEN rn >= 9 THEN CASE WHEN hh = ll THEN 50 ELSE 100 * (close - ll) / (hh - ll) END END"
_THIRD = "CASE WHEN ({v}) IS NULL THEN NULL WHEN p_{c} IS NULL THEN {v} ELSE ({v}) / 3 + p_{c} * 2 / 3 END"
_DX = "100 * abs(sp - sm) / nullif(sp + sm, 0)"
_FLIP = "(p_bull = 1 AND low < s) OR (p_bull = 0 AND high > s)"
_BETTER = "CASE WHEN p_bull = 1 THEN greatest(p_ep, high) ELSE least(p_ep, low) END"
_ON = "(p_way >= 0 AND close >= p_c) OR (p_way < 0 AND close <= p_c)"
_TURN = "NOT on_ AND ((p_way >= 0 AND move <= -5) OR (p_way < 0 AND move >= 5))"


def recurrences(bars: str) -> dict[str, str]:
    """Of the recurrences with their defaults."""
    w = lambda *a: walk(bars, *a)
    e = {"e": "close"}
    e123 = [{"e1": _ema("e1", "close", 20)}, {"e2": _ema("e2", "e1", 20)}, {"e3": _ema("e3", "e2", 20)}]
    adl = "sum(CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts)"
    force = "volume * sign(coalesce(high + low + close - lag(high + low + close) OVER w, 0))"
    found = {
        "keltner": w({"atr": _mean("tr", 10)}, e, [{"e": _ema("e", "close", 20)}], _after(20, keltner_upper="e + 2 * atr", keltner_middle="e", keltner_lower="e - 2 * atr")),
        "trix": w({}, {"e1": "close", "e2": "close", "e3": "close", "t": "NULL", "s": "NULL"}, [{"e1": _ema("e1", "close", 15)}, {"e2": _ema("e2", "e1", 15)}, {"e3": _ema("e3", "e2", 15)}, {"t": "100 * (e3 / p_e3 - 1)"}, {"s": _from("s", "t", 9)}], _after(54, trix="t", trix_signal="s")),
        "dema_tema": w({}, {"e1": "close", "e2": "close", "e3": "close"}, e123, _after(40, dema="2 * e1 - e2") | _after(60, tema="3 * e1 - 3 * e2 + e3")),
        "elder_ray": w({}, e, [{"e": _ema("e", "close", 13)}], _after(13, bull_power="high - e", bear_power="low - e")),
        "chaikin": w({"adl": adl}, {"f": "adl", "s": "adl"}, [{"f": _ema("f", "adl", 3), "s": _ema("s", "adl", 10)}], _after(10, chaikin="f - s")),
        "force_index": w({}, {"f": "NULL"}, [{"f": _from("f", "(close - pc) * volume", 13)}], _after(14, force_index="f")),
        "kdj": w({"hh": "max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)", "ll": "min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)"}, {"k": "NULL", "d": "NULL"}, [{"k": _THIRD.format(v=_RSV, c="k")}, {"d": _THIRD.format(v="k", c="d")}], {"kdj_k": "k", "kdj_d": "d", "kdj_j": "3 * k - 2 * d"}),
        "klinger": w({"force": force}, {"f": "force", "s": "force", "g": "0"}, [{"f": _ema("f", "force", 34), "s": _ema("s", "force", 55)}, {"g": _ema("g", "f - s", 13)}], {"klinger": "f - s", "klinger_signal": "g"}),
        "vema": w({"m20": _mean("close", 20)}, {"e": "NULL"}, [{"e": _seeded("e", 20)}], {"vema": "e"}),
        "vmacd": w({"m12": _mean("close", 12), "m26": _mean("close", 26)}, {"f": "NULL", "s": "NULL", "sum_": "0", "g": "NULL"}, [{"f": _seeded("f", 12), "s": _seeded("s", 26)}, {"sum_": "p_sum_ + CASE WHEN rn BETWEEN 26 AND 34 THEN f - s ELSE 0 END"}, {"g": f"CASE WHEN rn = 34 THEN sum_ / 9 WHEN rn > 34 THEN {_ema('g', 'f - s', 9)} END"}], {"vmacd": "f - s", "vmacd_signal": "g", "vmacd_hist": "f - s - g"}),
        "adx": w({}, {"t": "tr", "a": "plus", "b_": "minus", "d": "NULL"}, [{"t": _ema("t", "tr", 14), "a": _ema("a", "plus", 14), "b_": _ema("b_", "minus", 14)}, {"sp": "100 * a / nullif(t, 0)", "sm": "100 * b_ / nullif(t, 0)"}, {"d": _from("d", _DX, 14)}], _after(28, adx="d", plus_di="100 * a / nullif(t, 0)", minus_di="100 * b_ / nullif(t, 0)")),
        "adx_wilder": w({f"m_{c}": _mean(c, 14) for c in ("tr", "plus", "minus")}, {"t": "NULL", "a": "NULL", "b_": "NULL", "sum_": "0", "d": "NULL"}, [{"t": _wild("t", "tr", 14, 15, "m_tr"), "a": _wild("a", "plus", 14, 15, "m_plus"), "b_": _wild("b_", "minus", 14, 15, "m_minus")}, {"dx": "CASE WHEN rn >= 15 THEN coalesce(100 * abs(a - b_) / nullif(a + b_, 0), 0) ELSE 0 END"}, {"sum_": "p_sum_ + CASE WHEN rn <= 28 THEN dx ELSE 0 END"}, {"d": _wild("d", "dx", 14, 28, "sum_ / 14")}], {"adx_wilder": "d"}),
        "psar": w({}, {"sar": "close", "bull": "1", "af": "0.02", "ep": "high"}, [{"s": "p_sar + p_af * (p_ep - p_sar)"}, {"flip": _FLIP, "better": _BETTER}, {"sar": "CASE WHEN flip THEN p_ep ELSE s END", "bull": "CASE WHEN flip THEN 1 - p_bull ELSE p_bull END", "af": f"CASE WHEN flip THEN {_num(0.02)} WHEN better <> p_ep THEN least(p_af + {_num(0.02)}, {_num(0.2)}) ELSE p_af END", "ep": "CASE WHEN flip AND p_bull = 0 THEN high WHEN flip THEN low ELSE better END"}], _after(2, psar="sar", psar_side="2 * bull - 1")),
        "supertrend": w({"m_tr": _mean("tr", 10)}, {"a": "NULL", "hi": "NULL", "lo": "NULL", "way": "1"}, [{"a": _wild("a", "tr", 10, 10, "m_tr")}, {"u": "(high + low) / 2 + 3 * a", "d": "(high + low) / 2 - 3 * a"}, {"hi": "CASE WHEN p_hi IS NULL OR u < p_hi OR pc > p_hi THEN u ELSE p_hi END", "lo": "CASE WHEN p_lo IS NULL OR d > p_lo OR pc < p_lo THEN d ELSE p_lo END"}, {"way": "CASE WHEN close > hi THEN 1 WHEN close < lo THEN -1 ELSE p_way END"}], _after(11, supertrend="CASE WHEN way = 1 THEN lo ELSE hi END", supertrend_side="way")),
    }
    pivots = w({}, {"at_": "1", "c": "close", "way": "0", "piv": "NULL"}, [{"on_": _ON, "move": "(close - p_c) / p_c * 100"}, {"go": "on_ AND NOT (p_way = 0 AND move < 5)", "turn": _TURN}, {"at_": "CASE WHEN go OR turn THEN rn ELSE p_at_ END", "c": "CASE WHEN go OR turn THEN close ELSE p_c END", "way": "CASE WHEN turn THEN CASE WHEN p_way >= 0 THEN -1 ELSE 1 END WHEN go AND p_way = 0 THEN 1 ELSE p_way END", "piv": "CASE WHEN turn THEN p_at_ END"}], {"rn": "rn", "c": "close", "piv": "piv", "at_": "at_"})
    found["zigzag"] = f"WITH p AS ({pivots}) SELECT symbol, ts, CASE WHEN rn IN (SELECT piv FROM p q WHERE q.symbol = p.symbol AND piv IS NOT NULL) OR rn = (SELECT arg_max(at_, rn) FROM p q WHERE q.symbol = p.symbol) THEN c END AS zigzag FROM p"
    return found


def regimes(bars: str) -> dict[str, str]:
    """Market regimes and what follows from them, the windows as lists: tables as a WITH clause over r (symbol, rn, ts, regime, ...)."""
    back = lambda c, k: f"list({c}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    moved = "list_transform(range(2, len(c14) + 1), lambda i: CAST(c14[i] - c14[i - 1] AS DOUBLE))"
    tables = f"""a AS (SELECT *, row_number() OVER w AS rn, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM ({bars}) WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
        d AS (SELECT *, if(rn = 1, 0, list_max([high - low, abs(high - pc), abs(low - pc)])) AS tr, if(rn > 1 AND high - ph > greatest(pl - low, 0), high - ph, 0) AS up, if(rn > 1 AND pl - low > greatest(high - ph, 0), pl - low, 0) AS down FROM a),
        l AS (SELECT symbol, ts, rn, close, pc, {back('close', 50)} AS c50, {back('close', 200)} AS c200, {back('close', 15)} AS c14, {back('close / pc - 1', 20)} AS r20, {back('tr', 14)} AS t14, {back('up', 14)} AS u14, {back('down', 14)} AS d14 FROM d),
        i AS (SELECT *, list_avg(u14) * 100 / (list_avg(t14) + 1e-10) AS pdi, list_avg(d14) * 100 / (list_avg(t14) + 1e-10) AS mdi, list_sum(list_transform({moved}, lambda x: greatest(x, 0))) AS g, list_sum(list_transform({moved}, lambda x: greatest(-x, 0))) AS s FROM l),
        j AS (SELECT *, list_stddev_samp(r20) * sqrt(252) AS volatility, 0.3e0 * (close / list_avg(c50) - 1) + 0.3e0 * (close / list_avg(c200) - 1) + 0.4e0 * (list_avg(c50) / list_avg(c200) - 1) AS raw, if(s = 0, 100, g * 100 / (g + s)) AS rsi,
            {back('abs(pdi - mdi) * 100 / (pdi + mdi + 1e-10)', 14)} AS x14 FROM i),
        k AS (SELECT symbol, ts, rn, close / pc - 1 AS r, volatility, greatest(least(raw, 1), -1) AS trend, list_avg(x14) AS adx, rsi FROM j WHERE rn >= 200),
        r AS (SELECT *, CASE WHEN volatility > 0.4e0 THEN 'high_volatility' WHEN abs(trend) <= 0.05e0 THEN 'sideways' ELSE if(abs(trend) > 0.15e0 AND adx > 25, 'strong_', '') || if(trend > 0, 'uptrend', 'downtrend') END AS regime FROM k),
        t AS (SELECT p.symbol, p.regime, q.regime AS nxt, count(*) AS n, count(*)::DOUBLE / any_value(f.all_) AS p FROM r p JOIN r q ON q.symbol = p.symbol AND q.rn = p.rn + 1 JOIN (SELECT p.symbol, p.regime, count(*) AS all_ FROM r p JOIN r q ON q.symbol = p.symbol AND q.rn = p.rn + 1 GROUP BY ALL) f ON f.symbol = p.symbol AND f.regime = p.regime GROUP BY p.symbol, p.regime, q.regime)"""
    sure = "CASE WHEN regime = 'high_volatility' THEN 0.8e0 WHEN regime = 'sideways' THEN 0.7e0 WHEN starts_with(regime, 'strong') THEN least(0.9e0, 0.5e0 + abs(trend) + adx / 100) ELSE least(0.85e0, 0.6e0 + 2 * abs(trend)) END"
    shown = lambda e, c: f"round({e} + {metrics_nudge}, 5) + 0e0 AS {c}"
    spell = "SELECT symbol, regime, b, count(*) AS k FROM (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY rn) AS b FROM (SELECT *, if(regime = lag(regime) OVER (PARTITION BY symbol ORDER BY rn), 0, 1) AS new FROM r)) GROUP BY ALL"
    return {n: f"WITH {tables} {q}" for n, q in {
        "market_regimes": f"SELECT symbol, ts, regime, {shown(sure, 'confidence')}, {shown('trend', 'trend')}, {shown('volatility', 'volatility')}, {shown('rsi - 50', 'momentum')}, {shown('adx', 'adx')}, {shown('rsi', 'rsi')} FROM r",
        "regime_transitions": "SELECT symbol, regime, nxt, n, round(p, 6) AS p FROM t",
        "regime_stats": f"SELECT symbol, regime, count(*) AS n, {shown('avg(r) * 252', 'annual')}, {shown('stddev_samp(r) * sqrt(252)', 'vol')} FROM r GROUP BY symbol, regime",
        "regime_forecast": f"SELECT x.symbol, x.regime, z.nxt, round(sum(x.p * y.p * z.p) + {metrics_nudge}, 5) AS p FROM t x JOIN t y ON y.symbol = x.symbol AND y.regime = x.nxt JOIN t z ON z.symbol = x.symbol AND z.regime = y.nxt GROUP BY ALL",
        "regime_spells": f"SELECT symbol, regime, count(*) AS spells, round(avg(k) + {metrics_nudge}, 4) AS mean_bars, max(k) AS longest FROM ({spell}) GROUP BY symbol, regime",
    }.items()}
