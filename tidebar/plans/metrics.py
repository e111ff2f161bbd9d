"""Performance, drawdowns, streaks and calendars over value series (symbol, ts, value) and trades (symbol, trade_no, pnl, ...).

The variants differ in the deviation's divisor, the risk-free rate and the base; each is a plan of its own. Texts in SQL
run in other engines too, which is how they are verified."""

from __future__ import annotations

DAY = "PARTITION BY symbol ORDER BY ts"
RETURNS = f"SELECT symbol, ts, value, value / nullif(lag(value) OVER ({DAY}), 0) - 1 AS r, value / max(value) OVER ({DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd, row_number() OVER ({DAY}) AS rn, count(*) OVER (PARTITION BY symbol) AS n, first_value(value) OVER ({DAY}) AS v0, last_value(value) OVER ({DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v1 FROM series"


def performance(std: str = "stddev_samp", rf: float = 0.035, arithmetic: bool = False) -> str:
    """Total and annual return, volatility, Sharpe, Sortino, Calmar, drawdown. arithmetic: Sharpe from mean returns instead of the annual one."""
    sharpe = f"(avg(r) - {rf} / 252) / nullif({std}(r), 0) * sqrt(252)" if arithmetic else f"(power(max(v1 / v0), 252.0 / max(n)) - 1 - {rf}) / nullif({std}(r) * sqrt(252), 0)"
    return f"""SELECT symbol, CAST(max(n) AS BIGINT) AS bars, round(max(v1 / v0) - 1, 6) AS total_return,
        round(power(max(v1 / v0), 252.0 / max(n)) - 1, 6) AS annual_return, round({std}(r) * sqrt(252), 6) AS volatility,
        round({sharpe}, 5) AS sharpe,
        round((power(max(v1 / v0), 252.0 / max(n)) - 1 - {rf}) / nullif({std}(CASE WHEN r < 0 THEN r END) * sqrt(252), 0), 5) AS sortino,
        round(min(dd), 6) AS max_drawdown, round((power(max(v1 / v0), 252.0 / max(n)) - 1) / nullif(abs(min(dd)), 0), 5) AS calmar
        FROM ({RETURNS}) GROUP BY symbol"""


def drawdown_periods() -> str:
    """Peak-to-recovery periods: start, trough, length, depth; open ones have no recovery."""
    return f"""SELECT symbol, CAST(spell AS BIGINT) AS spell, min(ts) AS start_ts, CAST(count(*) AS BIGINT) AS bars, round(min(dd), 6) AS depth,
        round(sum(abs(dd)), 4) AS pain FROM (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER ({DAY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spell FROM ({RETURNS}))
        WHERE dd < 0 GROUP BY symbol, spell"""


def drawdown_summary() -> str:
    return f"""SELECT symbol, CAST(count(*) AS BIGINT) AS periods, CAST(max(bars) AS BIGINT) AS longest, round(min(depth), 6) AS deepest, round(avg(depth) + 0.000000137, 6) AS mean_depth FROM ({drawdown_periods()}) GROUP BY symbol"""


def ulcer_and_pain() -> str:
    return f"SELECT symbol, round(sqrt(avg(dd * dd)) * 100, 5) AS ulcer, round(avg(abs(dd)) * 100, 5) AS pain FROM ({RETURNS}) GROUP BY symbol"


def monthly_returns() -> str:
    """Month-end to month-end; the first month has none."""
    return f"""SELECT symbol, CAST(month AS BIGINT) AS month, round(last_value / nullif(lag(last_value) OVER (PARTITION BY symbol ORDER BY month), 0) - 1, 6) AS ret FROM (
        SELECT symbol, year(ts) * 100 + month(ts) AS month, max(CASE WHEN k = 1 THEN value END) AS last_value FROM (
            SELECT *, row_number() OVER (PARTITION BY symbol, year(ts) * 100 + month(ts) ORDER BY ts DESC) AS k FROM series) GROUP BY symbol, year(ts) * 100 + month(ts))"""


def intramonth_returns() -> str:
    return """SELECT symbol, CAST(month AS BIGINT) AS month, round(max(CASE WHEN b = 1 THEN value END) / nullif(max(CASE WHEN a = 1 THEN value END), 0) - 1, 6) AS ret FROM (
        SELECT symbol, value, year(ts) * 100 + month(ts) AS month, row_number() OVER (PARTITION BY symbol, year(ts) * 100 + month(ts) ORDER BY ts) AS a, row_number() OVER (PARTITION BY symbol, year(ts) * 100 + month(ts) ORDER BY ts DESC) AS b FROM series) GROUP BY symbol, month"""


def seasonality(part: str) -> str:
    """Mean, deviation, share of gains and count of daily returns by month, quarter or weekday (Monday 0)."""
    return f"SELECT symbol, CAST({part} AS INT) AS part, round(avg(r), 7) AS mean, round(stddev_samp(r), 7) AS std, round(avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate, CAST(count(r) AS BIGINT) AS n FROM ({RETURNS}) WHERE r IS NOT NULL GROUP BY symbol, {part}"


def moments(part: str) -> str:
    """Group counts, means and variances, from which an analysis of variance follows."""
    return f"SELECT symbol, {part} AS part, count(r) AS n, avg(r) AS mean, var_samp(r) AS var FROM ({RETURNS}) WHERE r IS NOT NULL GROUP BY symbol, {part}"


def tails(q: float = 0.05) -> str:
    """Historical VaR and CVaR of daily returns, and the parametric pair's moments."""
    quantile = lambda p: f"percentile_cont({p}) WITHIN GROUP (ORDER BY r)"
    return f"""SELECT t.symbol, round(q.var, 6) AS var, round(avg(CASE WHEN r <= q.var THEN r END), 6) AS cvar, round(avg(CASE WHEN r >= q.top THEN r END), 6) AS upside, round(avg(r), 7) AS mean, round(stddev_pop(r), 6) AS std
        FROM ({RETURNS}) t JOIN (SELECT symbol, {quantile(q)} AS var, {quantile(1 - q)} AS top FROM ({RETURNS}) GROUP BY symbol) q ON t.symbol = q.symbol GROUP BY t.symbol, q.var"""


def streaks() -> str:
    """Longest runs of winning and of losing trades (a loss is pnl <= 0)."""
    return """SELECT symbol, CAST(max(CASE WHEN w = 1 THEN len ELSE 0 END) AS BIGINT) AS wins, CAST(max(CASE WHEN w = 0 THEN len ELSE 0 END) AS BIGINT) AS losses FROM (
        SELECT symbol, w, run, count(*) AS len FROM (SELECT symbol, w, trade_no - row_number() OVER (PARTITION BY symbol, w ORDER BY trade_no) AS run FROM (SELECT symbol, trade_no, CASE WHEN pnl > 0 THEN 1 ELSE 0 END AS w FROM trades)) GROUP BY symbol, w, run) GROUP BY symbol"""


def trade_stats() -> str:
    return """SELECT symbol, CAST(count(*) AS BIGINT) AS trades, CAST(sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS BIGINT) AS wins, round(avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate,
        round(avg(pnl), 3) AS avg_pnl, round(avg(CASE WHEN pnl > 0 THEN pnl END), 3) AS avg_win, round(avg(CASE WHEN pnl <= 0 THEN pnl END), 3) AS avg_loss, round(sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / nullif(-sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END), 0), 5) AS profit_factor,
        round(avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END) * coalesce(avg(CASE WHEN pnl > 0 THEN pct END), 0) + (1 - avg(CASE WHEN pnl > 0 THEN 1e0 ELSE 0e0 END)) * coalesce(avg(CASE WHEN pnl <= 0 THEN pct END), 0), 6) AS expectancy FROM trades GROUP BY symbol"""


#: Bars of the looks back; the last takes all.
SPANS = (("1M", 21), ("3M", 63), ("6M", 126), ("1Y", 252), ("2Y", 504), ("3Y", 756), ("5Y", 1260), ("ALL", 2147483647))
NUDGE = "0.000000137"


def period_analysis() -> str:
    """Return, volatility and share of gains over the last bars of each span that has five or more."""
    spans = " UNION ALL ".join(f"SELECT '{k}' AS span, {n} AS len" for k, n in SPANS)
    back = f"SELECT symbol, ts, value, r, lag(value) OVER ({DAY}) AS prev, n - rn + 1 AS back FROM ({RETURNS})"
    return f"""SELECT symbol, span, CAST(count(*) AS BIGINT) AS bars, round(max_by(value, ts) / nullif(min_by(prev, ts), 0) - 1 + {NUDGE}, 6) AS total_return,
        round(stddev_samp(r) * sqrt(252) + {NUDGE}, 6) AS volatility, round(avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) + {NUDGE}, 6) AS win_rate
        FROM ({back}) JOIN ({spans}) s ON back <= len WHERE r IS NOT NULL GROUP BY symbol, span HAVING count(*) >= 5"""


def top_drawdowns(n: int = 5) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth, start_ts) AS k FROM ({drawdown_periods()})"
    return f"SELECT symbol, CAST(k AS INT) AS rank, start_ts, bars, depth FROM ({ranked}) WHERE k <= {n}"


def best_worst_months(n: int = 3) -> str:
    ranked = lambda kind, order: f"SELECT symbol, '{kind}' AS kind, row_number() OVER (PARTITION BY symbol ORDER BY ret {order}, month) AS k, month, ret FROM ({monthly_returns()}) WHERE ret IS NOT NULL"
    return f"SELECT symbol, kind, CAST(k AS INT) AS rank, month, ret FROM ({ranked('best', 'DESC')} UNION ALL {ranked('worst', 'ASC')}) WHERE k <= {n}"


def month_table() -> str:
    """Monthly returns, a row a year and a column a month."""
    months = ", ".join(f"max(CASE WHEN month % 100 = {m} THEN ret END) AS m{m:02}" for m in range(1, 13))
    return f"SELECT symbol, CAST(floor(month / 100) AS INT) AS year, {months} FROM ({monthly_returns()}) GROUP BY symbol, floor(month / 100)"


def tail_shape(q: float = 0.05) -> str:
    """Skewness and excess kurtosis (population), means and deviations of both tails, their ratio and the extremes."""
    quantile = lambda p: f"percentile_cont({p}) WITHIN GROUP (ORDER BY r)"
    z = f"SELECT symbol, r, (r - avg(r) OVER (PARTITION BY symbol)) / nullif(stddev_pop(r) OVER (PARTITION BY symbol), 0) AS z FROM ({RETURNS}) WHERE r IS NOT NULL"
    low, high = "CASE WHEN r <= q.low THEN r END", "CASE WHEN r >= q.high THEN r END"
    return f"""SELECT t.symbol, round(avg(z * z * z) + {NUDGE}, 5) AS skew, round(avg(z * z * z * z) - 3 + {NUDGE}, 5) AS kurtosis, round(avg({low}) + {NUDGE}, 6) AS low_mean, round(avg({high}) + {NUDGE}, 6) AS high_mean,
        round(stddev_samp({low}) + {NUDGE}, 6) AS low_std, round(stddev_samp({high}) + {NUDGE}, 6) AS high_std, round(abs(avg({high}) / nullif(avg({low}), 0)) + {NUDGE}, 5) AS tail_ratio, round(min(r) + {NUDGE}, 6) AS worst, round(max(r) + {NUDGE}, 6) AS best
        FROM ({z}) t JOIN (SELECT symbol, {quantile(q)} AS low, {quantile(1 - q)} AS high FROM ({RETURNS}) GROUP BY symbol) q ON t.symbol = q.symbol GROUP BY t.symbol"""


def split_effect(cond: str) -> str:
    """Daily returns where cond holds against the rest, with Welch's t and its degrees of freedom: January, half years and the like."""
    side = f"SELECT symbol, CASE WHEN {cond} THEN 1 ELSE 0 END AS inside, r FROM ({RETURNS}) WHERE r IS NOT NULL"
    pick = lambda f, k: f"{f}(CASE WHEN inside = {k} THEN r END)"
    a, b = (f"{pick('var_samp', k)} / nullif({pick('count', k)}, 0)" for k in (1, 0))
    return f"""SELECT symbol, CAST({pick('count', 1)} AS BIGINT) AS n_in, CAST({pick('count', 0)} AS BIGINT) AS n_out, round({pick('avg', 1)} + {NUDGE}, 6) AS mean_in, round({pick('avg', 0)} + {NUDGE}, 6) AS mean_out,
        round(({pick('avg', 1)} - {pick('avg', 0)}) / nullif(sqrt({a} + {b}), 0) + {NUDGE}, 4) AS t,
        round(({a} + {b}) * ({a} + {b}) / nullif(({a}) * ({a}) / nullif({pick('count', 1)} - 1, 0) + ({b}) * ({b}) / nullif({pick('count', 0)} - 1, 0), 0) + {NUDGE}, 2) AS df FROM ({side}) GROUP BY symbol"""


def holiday_effect(dates: tuple[str, ...]) -> str:
    """Returns of the last trading day before and the first after each date of a short list: as-of joins both ways."""
    days = " UNION ALL ".join(f"SELECT CAST('{d}' AS TIMESTAMP) AS holiday" for d in dates)
    return f"""SELECT symbol, holiday, max(CASE WHEN ts < holiday THEN ts END) AS before_ts, min(CASE WHEN ts > holiday THEN ts END) AS after_ts,
        round(max_by(r, CASE WHEN ts < holiday THEN ts END) + {NUDGE}, 6) AS before_r, round(min_by(r, CASE WHEN ts > holiday THEN ts END) + {NUDGE}, 6) AS after_r
        FROM ({RETURNS}) CROSS JOIN ({days}) h WHERE r IS NOT NULL GROUP BY symbol, holiday"""


def window_performance(windows: tuple[tuple[str, str, str], ...]) -> str:
    """Return and deepest fall within named spans of dates (name, from, to), cut to the dates there are: an interval join with a short list."""
    spans = " UNION ALL ".join(f"SELECT '{k}' AS span, CAST('{a}' AS TIMESTAMP) AS since, CAST('{b}' AS TIMESTAMP) AS until" for k, a, b in windows)
    inside = f"SELECT symbol, span, ts, value, value / max(value) OVER (PARTITION BY symbol, span ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS fall FROM series JOIN ({spans}) s ON ts >= since AND ts <= until"
    return f"SELECT symbol, span, CAST(count(*) AS BIGINT) AS bars, round(max_by(value, ts) / nullif(min_by(value, ts), 0) - 1 + {NUDGE}, 6) AS total_return, round(min(fall) + {NUDGE}, 6) AS max_drawdown FROM ({inside}) GROUP BY symbol, span HAVING count(*) >= 2"
