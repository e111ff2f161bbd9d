"""Registered queries of the library and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar import oracles
from tidebar.functions import costs, limits
from tidebar.operators import indicators, recurrences, simulate, steps
from tidebar.operators.simulate import Rules
from tidebar.plans import analytics, metrics, presets, quant, search
from tidebar.sources import bars as sources
from tidebar.streaming import bars as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_LI_KEY = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
LI = f"""SELECT l_returnflag || '-' || l_linestatus AS symbol, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts,
    arg_min(l_extendedprice / l_quantity, {_LI_KEY}) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    arg_max(l_extendedprice / l_quantity, {_LI_KEY}) AS close, CAST(sum(l_quantity) AS DOUBLE) AS volume FROM lineitem GROUP BY ALL"""
ORD = """SELECT o_orderpriority AS symbol, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, arg_min(o_totalprice, (o_orderkey, o_totalprice)) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
    arg_max(o_totalprice, (o_orderkey, o_totalprice)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY ALL"""
EV = """SELECT event_type AS symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE value IS NOT NULL GROUP BY ALL"""
SERIES = f"SELECT symbol, ts, close AS value FROM ({LI})"


def _bars_out(df: DataFrame) -> DataFrame:
    return df.select("symbol", "ts", *sources.PRICES, "volume")


def _bars_sql(q: str) -> str:
    return f"SELECT symbol, ts, open, high, low, close, volume FROM ({q})"


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.li_bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("value"))


def _over_series(text: str) -> Query:
    """A query in SQL over the closes."""
    return lambda spark, sf_dir: steps.query(text, series=_series(spark, sf_dir))


def _over_bars(text: str) -> Query:
    return lambda spark, sf_dir: steps.query(text, bars=sources.li_bars(spark, sf_dir))


def _with_series(text: str) -> str:
    return f"WITH series AS ({SERIES}) {text}"


# Sources, resampling, alignment
for _n, _f, _q in (("bars_lineitem", sources.li_bars, LI), ("bars_orders", sources.ord_bars, ORD), ("bars_events", sources.ev_bars, EV)):
    _add(_n, lambda s, d, f=_f: _bars_out(f(s, d)), _bars_sql(_q))
_RE = "SELECT symbol, {b} AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM ({q}) GROUP BY ALL"
_add("resample_week", lambda s, d: _bars_out(sources.resample(sources.li_bars(s, d), "W")), _bars_sql(_RE.format(b="CAST(date_trunc('week', ts) + INTERVAL 6 DAY AS TIMESTAMP)", q=LI)))
_add("resample_month", lambda s, d: _bars_out(sources.resample(sources.li_bars(s, d), "M")), _bars_sql(_RE.format(b="CAST(last_day(CAST(ts AS DATE)) AS TIMESTAMP)", q=LI)))
_COLS = ", ".join((*sources.PRICES, "volume"))
_GRID = "WITH b AS ({q}), d AS ({d}), g AS (SELECT ts, symbol FROM d CROSS JOIN (SELECT DISTINCT symbol FROM b)) SELECT * FROM (SELECT symbol, ts, {v} FROM g LEFT JOIN b USING (symbol, ts)) {w}"
_add("align_inner", lambda s, d: _bars_out(sources.align(sources.ord_bars(s, d), "inner", "drop")), _bars_sql(_GRID.format(q=ORD, d="SELECT ts FROM b GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM b)", v=_COLS, w="WHERE close IS NOT NULL")))
_add("align_outer_ffill", lambda s, d: _bars_out(sources.align(sources.ord_bars(s, d), "outer", "ffill")), _bars_sql(_GRID.format(q=ORD, d="SELECT DISTINCT ts FROM b", v=", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in (*sources.PRICES, "volume")), w="WHERE close IS NOT NULL")))
_add("align_left_zero", lambda s, d: _bars_out(sources.align(sources.ord_bars(s, d), "left", "zero", "1-URGENT")), _bars_sql(_GRID.format(q=ORD, d="SELECT DISTINCT ts FROM b WHERE symbol = '1-URGENT'", v=", ".join(f"coalesce({c}, 0) AS {c}" for c in (*sources.PRICES, "volume")), w="")))


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sources.li_bars(spark, sf_dir)
    return _bars_out(sources.upserted(b.where("ts < '1997-01-01'"), b.where("ts >= '1996-01-01'").withColumn("close", F.col("close") + 1)))


_add("cache_upsert", _upsert, _bars_sql(f"SELECT symbol, ts, open, high, low, CASE WHEN ts >= '1996-01-01' THEN close + 1 ELSE close END AS close, volume FROM ({LI})"))
_add("recent_history", lambda s, d: _bars_out(sources.li_bars(s, d).withColumn("k", F.expr("row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)")).where("k <= 20").drop("k")), _bars_sql(f"SELECT * FROM ({LI}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20"))


# Window indicators and signals
def _spec_query(spec: steps.Spec) -> Query:
    return lambda spark, sf_dir: steps.rounded(steps.apply(sources.li_bars(spark, sf_dir), spec), spec)


for _n, _f in indicators.INDICATORS.items():
    _p = indicators.volume_index(log=True) if _n == "volume_index" else _f()  # the index itself grows out of any fixed number of decimals
    _add(f"ind_{_n}", _spec_query(_p), steps.sql(LI, _p))
_add("ind_bollinger_pop", _spec_query(indicators.bollinger(20, 2.0, "stddev_pop")), steps.sql(LI, indicators.bollinger(20, 2.0, "stddev_pop")))
_add("ind_stochastic_flat50", _spec_query(indicators.stochastic(14, 3, "50")), steps.sql(LI, indicators.stochastic(14, 3, "50")))
for _n, _f in indicators.SIGNALS.items():
    _add(f"sig_{_n}", _spec_query(_f()), steps.sql(LI, _f()))


# Recurrences
def _rec(*names: str, nudge: float = 0.0) -> Query:
    cols = [c for n in names for c in recurrences.columns(n)]
    return lambda spark, sf_dir: recurrences.apply(sources.li_bars(spark, sf_dir), list(names)).select("symbol", "ts", *[F.round(F.col(c) + nudge, 4).alias(c) for c in cols])


_NUM = f"b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM ({LI}))"
_add(
    "rec_ema", _rec("ema"),
    f"WITH RECURSIVE {_NUM}, r AS (SELECT symbol, ts, rn, close AS e FROM b WHERE rn = 1 UNION ALL SELECT b.symbol, b.ts, b.rn, b.close * (2.0::DOUBLE / 21) + r.e * (19.0::DOUBLE / 21) FROM r JOIN b ON b.symbol = r.symbol AND b.rn = r.rn + 1) SELECT symbol, ts, CASE WHEN rn >= 20 THEN round(e, 4) END AS ema FROM r",
)
_add(
    "rec_macd", _rec("macd"),
    f"""WITH RECURSIVE {_NUM}, r AS (SELECT symbol, ts, rn, close AS f, close AS s, 0.0::DOUBLE AS g FROM b WHERE rn = 1 UNION ALL
        SELECT symbol, ts, rn, f, s, (f - s) * 0.2::DOUBLE + g * 0.8::DOUBLE FROM (SELECT b.symbol, b.ts, b.rn, b.close * (2.0::DOUBLE / 13) + r.f * (11.0::DOUBLE / 13) AS f, b.close * (2.0::DOUBLE / 27) + r.s * (25.0::DOUBLE / 27) AS s, r.g FROM r JOIN b ON b.symbol = r.symbol AND b.rn = r.rn + 1))
        SELECT symbol, ts, CASE WHEN rn >= 35 THEN round(f - s, 4) END AS macd, CASE WHEN rn >= 35 THEN round(g, 4) END AS macd_signal, CASE WHEN rn >= 35 THEN round(f - s - g, 4) END AS macd_hist FROM r""",
)
_TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
_add(
    "rec_atr_wilder", _rec("atr_wilder"),
    f"""WITH RECURSIVE {_NUM}, t AS (SELECT symbol, ts, rn, {_TR} AS tr FROM b), r AS (SELECT symbol, max(ts) AS ts, CAST(14 AS BIGINT) AS rn, avg(tr) AS a FROM t WHERE rn <= 14 GROUP BY symbol UNION ALL
        SELECT t.symbol, t.ts, t.rn, (r.a * 13 + t.tr) / 14 FROM r JOIN t ON t.symbol = r.symbol AND t.rn = r.rn + 1)
        SELECT t.symbol, t.ts, round(r.a, 4) AS atr_wilder FROM t LEFT JOIN r ON t.symbol = r.symbol AND t.rn = r.rn""",
)
_add(
    "rec_rsi_wilder", _rec("rsi_wilder"),
    f"""WITH RECURSIVE {_NUM}, t AS (SELECT symbol, ts, rn, greatest(close - pc, 0) AS g, greatest(pc - close, 0) AS l FROM b), r AS (SELECT symbol, max(ts) AS ts, CAST(15 AS BIGINT) AS rn, avg(g) AS g, avg(l) AS l FROM t WHERE rn BETWEEN 2 AND 15 GROUP BY symbol UNION ALL
        SELECT t.symbol, t.ts, t.rn, (r.g * 13 + t.g) / 14, (r.l * 13 + t.l) / 14 FROM r JOIN t ON t.symbol = r.symbol AND t.rn = r.rn + 1)
        SELECT t.symbol, t.ts, round(CASE WHEN r.l = 0 THEN 100 ELSE 100 - 100 / (1 + r.g / r.l) END, 4) AS rsi_wilder FROM t LEFT JOIN r ON t.symbol = r.symbol AND t.rn = r.rn""",
)
for _n, _q in oracles.recurrences(LI).items():
    _add(f"rec_{_n}", _rec(_n, nudge=float(steps.NUDGE)), _q)

# Simulation
_METRIC = [f"round({c}, 4) AS {c}" for c in simulate.METRICS]
for _n, _s in (("golden_cross", "goldenCross"), ("rsi", "rsi"), ("macd", "macd"), ("bollinger", "bollinger"), ("breakout", "breakout")):
    _add(f"backtest_{_n}", lambda s, d, k=_s: simulate.backtest(sources.li_bars(s, d), k).selectExpr("symbol", *_METRIC), oracles.metrics(oracles.strategy_signals(LI, _s), Rules()))
_GOLDEN = oracles.strategy_signals(LI, "goldenCross")
_STOPS = Rules(stop=5, take=10, trail=8)
_add("backtest_stops", lambda s, d: simulate.backtest(sources.li_bars(s, d), "goldenCross", _STOPS).selectExpr("symbol", *_METRIC), oracles.metrics(_GOLDEN, _STOPS))
_add("backtest_next_open", lambda s, d: simulate.backtest(sources.li_bars(s, d), "goldenCross", Rules(fill="open")).selectExpr("symbol", *_METRIC), oracles.metrics(_GOLDEN, Rules(fill="open")))
_add("equity_curve", lambda s, d: simulate.trace(sources.li_bars(s, d), "goldenCross").withColumn("equity", F.round("equity", 4)), oracles.equity(_GOLDEN, Rules()).replace("SELECT symbol, ts, equity FROM run", "SELECT symbol, ts, round(equity, 4) AS equity FROM run"))
_add("trades", lambda s, d: simulate.trace(sources.li_bars(s, d), "goldenCross", what="trades").select("symbol", "ts", "side", *[F.round(c, 4).alias(c) for c in ("price", "quantity", "pnl")]),
     f"SELECT symbol, ts, side, round(price, 4) AS price, round(quantity, 4) AS quantity, round(pnl, 4) + 0e0 AS pnl FROM ({oracles.trades(_GOLDEN, Rules())})")
_add("rebalance_monthly", lambda s, d: simulate.rebalanced(sources.ord_bars(s, d), {"1-URGENT": 0.4, "2-HIGH": 0.3, "3-MEDIUM": 0.3}))
for _n in presets.PRESETS:
    _p = presets.PRESETS[_n]
    _q = oracles.preset_signals(LI, _p)
    _add(f"preset_{_n}", lambda s, d, k=_n: presets.run(sources.li_bars(s, d), k).selectExpr("symbol", *_METRIC), _q and oracles.metrics(_q, Rules(fill="open", stop=_p.stop, take=_p.take, trail=_p.trail)))


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = sources.li_bars(spark, sf_dir)
    sig = steps.apply(b, indicators.golden_cross()).where("signal = 1")
    return b, sig.select(F.concat_ws("@", "symbol", F.date_format("ts", "yyyyMMdd")).alias("order_id"), "symbol", "ts", F.col("close").alias("price"))


_add("bracket_orders", lambda s, d: simulate.orders(*_entries(s, d), 5.0, 10.0).select("order_id", "symbol", "exit_ts", "hit", F.round(F.col("exit_price") + 0.00000137, 4).alias("exit_price")),
     f"""WITH e AS (SELECT symbol, ts, close FROM (SELECT symbol, ts, close, signal FROM ({steps.sql(LI, indicators.golden_cross())}) JOIN (SELECT symbol, ts, close FROM ({LI})) USING (symbol, ts)) WHERE signal = 1),
     j AS (SELECT e.symbol || '@' || strftime(e.ts, '%Y%m%d') AS order_id, e.symbol, b.ts, CASE WHEN b.high >= e.close * 1.1::DOUBLE THEN 'take' WHEN b.low <= e.close * 0.95::DOUBLE THEN 'stop' END AS hit, e.close AS paid FROM e JOIN ({LI}) b ON b.symbol = e.symbol AND b.ts > e.ts)
     SELECT order_id, symbol, ts AS exit_ts, hit, round(paid * CASE WHEN hit = 'take' THEN 1.1::DOUBLE ELSE 0.95::DOUBLE END + 0.00000137, 4) AS exit_price FROM j WHERE hit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts) = 1""")
_SPACE = {"fast": search.int_range(5, 14), "slow": search.int_range(20, 39)}
_add("sweep_golden_cross", lambda s, d: search.ranked(simulate.sweep(sources.li_bars(s, d), search.grid(s, _SPACE), "goldenCross")).selectExpr("symbol", "rank", "fast", "slow", *_METRIC))
_add("sweep_summary", lambda s, d: search.summary(simulate.sweep(sources.li_bars(s, d), search.random_sample(s, _SPACE, 100), "goldenCross")))
_FOLDS = search.folds(dt.date(1993, 1, 1), dt.date(1998, 1, 1), 12, 6)
_SMALL = {"fast": [5, 10, 15], "slow": [20, 30, 40]}
_add("walk_forward", lambda s, d: search.walk_forward(sources.li_bars(s, d), _FOLDS, search.grid(s, _SMALL), "goldenCross"))
_add("walk_forward_robustness", lambda s, d: search.robustness(search.walk_forward(sources.li_bars(s, d), _FOLDS, search.grid(s, _SMALL), "goldenCross")))

# Costs over orders: each line item as an order
_ORDERS = "SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS part, l_extendedprice / l_quantity AS price, l_quantity AS q, CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END AS side, l_extendedprice AS value FROM lineitem"


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = steps.query(_ORDERS, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    price, q, side, value = (F.col(c) for c in ("price", "q", "side", "value"))
    out = {"percent": costs.commission_percent(value, 0.00015, 1.0), "korea": costs.commission_korea(value, side), "us": costs.commission_us(q, value), "slip": costs.slip_percent(price, side), "slip_volume": costs.slip_volume(price, side, q, F.lit(1000.0)), "ratio": costs.fill_ratio(q / 1000), "impact": costs.impact("sqrt", q / 1000, F.lit(0.02)), "risk_size": costs.size_risk(price, price * 0.95, F.lit(1e6)).cast("double")}
    return o.groupBy("side").agg(*[F.round(F.sum(e), 1).alias(n) for n, e in out.items()], F.count("*").alias("n"))


_add("order_costs", _costs, f"""SELECT side, round(sum(greatest(value * 0.00015::DOUBLE, 1)), 1) AS percent, round(sum(value * 0.00015::DOUBLE + CASE WHEN side = 'SELL' THEN value * 0.0018::DOUBLE ELSE 0 END), 1) AS korea, round(sum(least(greatest(q * 0.005::DOUBLE, 1), value * 0.01::DOUBLE)), 1) AS us,
    round(sum(price * (1 + CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * 0.001::DOUBLE)), 1) AS slip, round(sum(price * (1 + CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * least(q / 1000 * 0.1::DOUBLE, 0.02::DOUBLE))), 1) AS slip_volume,
    round(sum(CASE WHEN q / 1000 <= 0.01 THEN 1.0::DOUBLE WHEN q / 1000 <= 0.05 THEN 0.95::DOUBLE ELSE 0.85::DOUBLE END), 1) AS ratio, round(sum(0.1::DOUBLE * sqrt(q / 1000)), 1) AS impact, round(sum(floor(20000.0::DOUBLE / abs(price - price * 0.95::DOUBLE))), 1) AS risk_size, count(*) AS n FROM ({_ORDERS}) GROUP BY side""")

# Metrics and statistics: one text, two engines
_T = "SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS trade_no, value - lag(value) OVER (PARTITION BY symbol ORDER BY ts) AS pnl, (value / nullif(lag(value) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1) * 100 AS pct FROM series"
_TEXTS = {
    "metrics_event": metrics.performance(), "metrics_population": metrics.performance("stddev_pop", 0.035, True), "metrics_benchmark": metrics.performance("stddev_samp", 0.02), "metrics_signal": metrics.performance("stddev_pop", 0.0, True),
    "drawdown_periods": metrics.drawdown_periods(), "drawdown_summary": metrics.drawdown_summary(), "ulcer_and_pain": metrics.ulcer_and_pain(), "monthly_returns": metrics.monthly_returns(), "intramonth_returns": metrics.intramonth_returns(),
    "seasonality_month": metrics.seasonality("month(ts)"), "seasonality_quarter": metrics.seasonality("quarter(ts)"), "value_at_risk": metrics.tails(),
    "streaks": metrics.streaks(), "trade_stats": metrics.trade_stats(),
    "correlation": quant.correlation(), "rank_correlation": quant.rank_correlation(), "relative_metrics": quant.relative("A-F"), "rolling_relative": quant.rolling_relative("A-F"), "cointegration": quant.cointegration(), "entropy": quant.entropy(),
    "factor_columns": quant.factors(),
    "period_analysis": metrics.period_analysis(), "top_drawdowns": metrics.top_drawdowns(), "best_worst_months": metrics.best_worst_months(), "month_table": metrics.month_table(), "tail_shape": metrics.tail_shape(),
    "january_effect": metrics.split_effect("month(ts) = 1"), "summer_effect": metrics.split_effect("month(ts) BETWEEN 5 AND 10"), "holiday_effect": metrics.holiday_effect(tuple(f"{y}-12-25" for y in range(1993, 1998))),
    "window_performance": metrics.window_performance((("first", "1992-03-01", "1992-09-30"), ("middle", "1994-02-01", "1995-01-31"), ("last", "1998-01-01", "2000-01-01"))),
    "mutual_information": quant.mutual_information(), "transfer_entropy": quant.transfer_entropy(), "rolling_correlation": quant.rolling_correlation(), "spread_bands": quant.spread_bands(), "find_pairs": quant.find_pairs(),
    "volatility_classes": quant.volatility_classes(), "diversification": quant.diversification(), "price_regimes": quant.price_regimes(),
}
for _n, _t in _TEXTS.items():
    _x = f"WITH trades AS (SELECT * FROM ({_T}) WHERE pnl IS NOT NULL) {_t}" if _n in ("streaks", "trade_stats") else _t
    _add(_n, _over_series(_x), f"WITH series AS ({SERIES}), trades AS (SELECT * FROM ({_T}) WHERE pnl IS NOT NULL) {_t}" if _x is not _t else _with_series(_t))
_add("seasonality_weekday", _over_series(metrics.seasonality("weekday(ts)")), _with_series(metrics.seasonality("(isodow(ts) - 1)")))

_REGIMES = {"market_regimes": quant.market_regimes(), "regime_transitions": quant.transitions(), "regime_stats": quant.regime_stats(), "regime_forecast": quant.regime_forecast(), "regime_spells": quant.regime_spells()}
for _n, _q in oracles.regimes(LI).items():
    _add(_n, _over_bars(_REGIMES[_n]), _q)


def _accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.query(quant.forward_accuracy(), signals=steps.apply(sources.li_bars(spark, sf_dir), indicators.golden_cross()))


_add("forward_accuracy", _accuracy, f"WITH signals AS (SELECT symbol, ts, close, signal FROM ({steps.sql(LI, indicators.golden_cross())}) JOIN (SELECT symbol, ts, close FROM ({LI})) USING (symbol, ts)) {quant.forward_accuracy()}")


# Analyses of a strategy's equity and trades
def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.round_trips(simulate.trace(sources.li_bars(spark, sf_dir), "goldenCross", what="trades"))


def _equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulate.trace(sources.li_bars(spark, sf_dir), "goldenCross").withColumnRenamed("equity", "value")


def _scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("none", 0.0, 0.0, 0.0), ("base", 0.00015, 0.001, 0.0018), ("double", 0.0003, 0.002, 0.0036)], "name string, commission double, slippage double, tax double")


def _bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _over_series(f"SELECT symbol, rn - 2 AS k, r FROM ({metrics.RETURNS}) WHERE r IS NOT NULL")(spark, sf_dir)
    return search.bands(search.bootstrap(r, 200, 60))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _over_series(f"SELECT a || '/' || b AS pair, ts, ln(va) - ln(vb) AS s FROM ({quant.PAIRS})")(spark, sf_dir)
    w = "OVER (PARTITION BY pair ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    return analytics.pairs_signals(s.selectExpr("pair", "ts", f"CASE WHEN count(s) {w} = 20 THEN (s - avg(s) {w}) / nullif(stddev_samp(s) {w}, 0) END AS z"))


def _factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_series(f"SELECT r.symbol, r.ts, r.r, f.momentum, f.volatility FROM ({metrics.RETURNS}) r JOIN (SELECT symbol, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS ts, momentum, volatility FROM ({quant.factors()})) f ON r.symbol = f.symbol AND r.ts = f.ts")(spark, sf_dir)


def _factor_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.factor_fit(_factor_returns(spark, sf_dir), ["momentum", "volatility"])


def _pair_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_series(quant.PAIRS)(spark, sf_dir)


def _gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.gaussian(_over_series(f"SELECT symbol, avg(r) AS mean, stddev_samp(r) AS std FROM ({metrics.RETURNS}) WHERE r IS NOT NULL GROUP BY symbol")(spark, sf_dir), 200, 60)


def _trend_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sources.li_bars(spark, sf_dir)
    b = _signalled(spark, sf_dir).join(recurrences.apply(b, ["adx_wilder"]), ["symbol", "ts"])
    return steps.apply(b, indicators.trend_filter("adx_wilder")).select("symbol", "ts", "signal", "filtered")


def _signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.apply(sources.li_bars(spark, sf_dir), indicators.golden_cross())


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sources.li_bars(spark, sf_dir)
    return reduce(DataFrame.unionByName, [simulate.trace(b, k).select("symbol", F.lit(k).alias("strategy"), "ts", F.col("equity").alias("value")) for k in ("goldenCross", "rsi", "breakout")])


def _all_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = sources.li_bars(spark, sf_dir)
    return reduce(DataFrame.unionByName, [steps.apply(b, f()).select("symbol", "ts", F.lit(k).alias("strategy"), "signal") for k, f in indicators.SIGNALS.items()])


def _what_if_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net result under commissions (hundredths of a basis point) by slippages (basis points)."""
    rows = [(f"c{100 * c}_s{s}", c / 1e4, s / 1e4, 0.0018) for c in (0, 1, 2, 3) for s in (0, 5, 10, 20)]
    grid = spark.createDataFrame(rows, "name string, commission double, slippage double, tax double")
    return analytics.what_if(_trips(spark, sf_dir), grid).groupBy("symbol").pivot("name", [r[0] for r in rows]).agg(F.first("net"))


_PER = {"fractal": (analytics.hurst_of, "hurst double, dfa double, dimension double"), "gmm_regimes": (analytics.gmm_of, "bear double, sideways double, bull double, persistence double"), "price_forecast": (analytics.forecast_of, "forecast double, direction int, confidence double, volatility double"), "strategy_dna": (analytics.dna_of, "dna array<double>")}
for _n, (_f, _s) in _PER.items():
    _add(_n, lambda s, d, f=_f, k=_s: analytics.per_symbol(_series(s, d), f, k))
_add("journal", lambda s, d: analytics.journal(_trips(s, d), _equity(s, d)))
_add("trades_page", lambda s, d: analytics.trades_page(_trips(s, d), "winners", sort="pnl", descending=True))
_add("what_if", lambda s, d: analytics.what_if(_trips(s, d), _scenarios(s)))
_add("leaderboard", lambda s, d: analytics.leaderboard(simulate.backtest(sources.li_bars(s, d), "goldenCross")))
_add("dashboard_rank", lambda s, d: analytics.dashboard_rank(simulate.backtest(sources.li_bars(s, d), "goldenCross")))
_add("health", lambda s, d: analytics.health(_over_series(metrics.performance())(s, d)))
_add("stress", lambda s, d: analytics.stress(_over_series(metrics.performance())(s, d)))
_add("similar_strategies", lambda s, d: analytics.similar(analytics.per_symbol(_series(s, d), analytics.dna_of, "dna array<double>")))
_add("consensus_signals", lambda s, d: analytics.consensus(sources.li_bars(s, d)))
_add("bootstrap_bands", _bootstrap)
_add("pairs_trading", _pairs)
_add("factor_fit", _factor_fit)
_add("portfolio_weights", lambda s, d: s.createDataFrame(analytics.portfolio(_series(s, d), "sharpe")))

_add("factor_attribution", lambda s, d: analytics.attribution(_factor_returns(s, d), _factor_fit(s, d), ["momentum", "volatility"]))
_add("correlation_tests", lambda s, d: analytics.correlation_tests(_pair_returns(s, d)))
_add("kendall", lambda s, d: analytics.correlation_tests(_pair_returns(s, d)).select("a", "b", F.round(F.col("kendall") + 0.00000137, 5).alias("tau")),
     _with_series(f"""SELECT a, b, round(sum(sign(dx) * sign(dy)) / sqrt(sum(abs(sign(dx)))::DOUBLE * sum(abs(sign(dy)))) + 0.00000137, 5) AS tau FROM (SELECT p.a, p.b, p.x - q.x AS dx, p.y - q.y AS dy FROM p JOIN p q ON p.a = q.a AND p.b = q.b AND p.ts < q.ts) GROUP BY a, b""").replace(f"({SERIES}) ", f"({SERIES}), p AS ({quant.PAIRS}) ", 1))
_add("rolling_max_drawdown", lambda s, d: analytics.rolling_max_drawdown(_series(s, d)).select("symbol", "ts", F.round(F.col("max_drawdown") + 0.00000137, 5).alias("max_drawdown")),
     _with_series("""SELECT symbol, ts, CASE WHEN count(*) >= 2 THEN round(min(fall) + 0.00000137, 5) END AS max_drawdown FROM (SELECT b.symbol, b.ts, a.value / max(a.value) OVER (PARTITION BY b.symbol, b.rn ORDER BY a.rn) - 1 AS fall FROM n b JOIN n a ON a.symbol = b.symbol AND a.rn BETWEEN b.rn - 251 AND b.rn) GROUP BY symbol, ts""").replace(f"({SERIES}) ", f"({SERIES}), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM series) ", 1))
_add("gaussian_bands", lambda s, d: search.bands(_gaussian(s, d)))
_add("simulated_risk", lambda s, d: search.simulated_risk(_gaussian(s, d)))
_add("efficient_frontier", lambda s, d: s.createDataFrame(analytics.frontier(_series(s, d)), "target double, volatility double, sharpe double, weights map<string, double>"))
_add("what_if_grid", _what_if_grid)
_add("sig_trend_filter", _trend_filtered)
_add("backtest_shared_purse", lambda s, d: simulate.shared(_signalled(s, d)))
_add("signal_backtest", lambda s, d: simulate.signal_backtest(_signalled(s, d)))
_FACTORS = ["momentum", "volatility"]
_add("rolling_factors", lambda s, d: analytics.rolling_factors(_factor_returns(s, d), _FACTORS))
_add("factor_risk", lambda s, d: analytics.factor_risk(_factor_returns(s, d), _factor_fit(s, d), _FACTORS))
_add("low_correlation", lambda s, d: s.createDataFrame([(i, n) for i, n in enumerate(analytics.low_correlation(_over_series(quant.correlation())(s, d)))], "place int, symbol string"))
_add("correlation_clusters", lambda s, d: s.createDataFrame(analytics.clusters(_over_series(quant.correlation())(s, d)), "symbol string, cluster int"))
_add("strength_buckets", lambda s, d: analytics.strength_buckets(analytics.consensus(sources.li_bars(s, d))))
_add("combined_strategies", lambda s, d: analytics.combined(_curves(s, d), "sharpe"))
_add("strategy_advice", lambda s, d: analytics.advice(_over_bars(quant.regimes())(s, d)))
_add("voting_signal", lambda s, d: analytics.voted(_all_signals(s, d)),
     "SELECT symbol, ts, CAST(CASE WHEN sum(CASE WHEN signal = 1 THEN 1 ELSE 0 END) / count(*) >= 0.5 THEN 1 WHEN sum(CASE WHEN signal = -1 THEN 1 ELSE 0 END) / count(*) >= 0.5 THEN -1 ELSE 0 END AS INT) AS signal FROM ("
     + " UNION ALL ".join(steps.sql(LI, f()) for f in indicators.SIGNALS.values()) + ") GROUP BY symbol, ts")
_LIMITED = f"""SELECT custkey, orderkey, {limits.verdict()} AS verdict FROM (SELECT o_custkey AS custkey, o_orderkey AS orderkey, 'BUY' AS side, o_totalprice AS value, 2000000e0 AS equity, 2000000e0 AS peak, 2000000e0 AS day_start, 0 AS own,
    count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS open_positions,
    sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - o_totalprice AS held, row_number() OVER (PARTITION BY o_custkey, date_trunc('day', o_orderdate) ORDER BY o_orderkey) AS nth FROM orders)"""


def _risk_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.query(_LIMITED, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


_add("risk_limits", _risk_limits, _LIMITED)


# Streaming plans, over the same rows in batch
def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("seq"))


_add("stream_bars", lambda s, d: _bars_out(streaming.bars(_ticks(s, d))), _bars_sql(EV))
_add("stream_sessions", lambda s, d: streaming.sessions(_ticks(s, d), "10 minutes"))
