"""Several symbols together: correlation, benchmark, pairs, factors, entropy, market regimes. SQL over `series` (symbol, ts, value)."""

from __future__ import annotations

from tidebar.plans.metrics import DAY, NUDGE, RETURNS

#: Returns of two symbols on common dates. A theta join on the symbols' names: a row a pair and date.
PAIRS = f"SELECT a.symbol AS a, b.symbol AS b, a.ts AS ts, a.r AS x, b.r AS y, a.value AS va, b.value AS vb FROM ({RETURNS}) a JOIN ({RETURNS}) b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL"


def correlation() -> str:
    return f"SELECT a, b, CAST(count(*) AS BIGINT) AS n, round(corr(x, y), 6) AS corr, round(covar_samp(x, y) * 252, 6) AS cov FROM ({PAIRS}) GROUP BY a, b"


def rank_correlation() -> str:
    """Spearman: the correlation of average ranks."""
    rank = lambda v: f"(rank() OVER (PARTITION BY a, b ORDER BY {v}) + (count(*) OVER (PARTITION BY a, b, {v}) - 1) / 2.0)"
    return f"SELECT a, b, round(corr(rx, ry), 6) AS spearman FROM (SELECT a, b, {rank('x')} AS rx, {rank('y')} AS ry FROM ({PAIRS})) GROUP BY a, b"


def relative(bench: str) -> str:
    """Each symbol against a benchmark: beta, alpha, R2, tracking error, information ratio, capture, Treynor."""
    both = f"SELECT s.symbol, s.r AS r, b.r AS q FROM ({RETURNS}) s JOIN ({RETURNS}) b ON s.ts = b.ts AND b.symbol = '{bench}' AND s.symbol <> b.symbol WHERE s.r IS NOT NULL AND b.r IS NOT NULL"
    return f"""SELECT symbol, round(regr_slope(r, q), 6) AS beta, round(regr_intercept(r, q) * 252, 6) AS alpha, round(regr_r2(r, q), 6) AS r2, round(stddev_samp(r - q) * sqrt(252), 6) AS tracking_error,
        round(avg(r - q) * 252 / nullif(stddev_samp(r - q) * sqrt(252), 0), 6) AS information_ratio, round(avg(CASE WHEN q > 0 THEN r END) / nullif(avg(CASE WHEN q > 0 THEN q END), 0), 6) AS up_capture, round(avg(CASE WHEN q < 0 THEN r END) / nullif(avg(CASE WHEN q < 0 THEN q END), 0), 6) AS down_capture FROM ({both}) GROUP BY symbol"""


def rolling_relative(bench: str, n: int = 60) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    both = f"SELECT s.symbol, s.ts, s.r AS r, b.r AS q FROM ({RETURNS}) s JOIN ({RETURNS}) b ON s.ts = b.ts AND b.symbol = '{bench}' AND s.symbol <> b.symbol WHERE s.r IS NOT NULL AND b.r IS NOT NULL"
    guard = lambda x: f"CASE WHEN count(*) {w} >= {int(0.8 * n)} THEN round({x} + {NUDGE}, 4) + 0e0 END"
    return f"SELECT symbol, ts, {guard(f'regr_slope(r, q) {w}')} AS beta, {guard(f'corr(r, q) {w}')} AS corr FROM ({both})"


def cointegration() -> str:
    """Hedge ratio of logs, and the spread's Dickey-Fuller regression: theta, its t-value, half-life."""
    hedge = f"SELECT a, b, regr_slope(ln(va), ln(vb)) AS h, regr_intercept(ln(va), ln(vb)) AS c FROM ({PAIRS}) GROUP BY a, b"
    spread = f"SELECT p.a, p.b, ts, ln(va) - h * ln(vb) - c AS s, h FROM ({PAIRS}) p JOIN ({hedge}) k ON p.a = k.a AND p.b = k.b"
    step = f"SELECT a, b, h, s - lag(s) OVER (PARTITION BY a, b ORDER BY ts) AS d, lag(s) OVER (PARTITION BY a, b ORDER BY ts) AS l FROM ({spread})"
    return f"""SELECT a, b, round(max(h), 5) AS hedge, round(regr_slope(d, l), 5) AS theta,
        round(regr_slope(d, l) / nullif(sqrt((regr_syy(d, l) - regr_slope(d, l) * regr_sxy(d, l)) / nullif(count(d) - 2, 0) / nullif(regr_sxx(d, l), 0)), 0), 4) AS t_value,
        round(CASE WHEN regr_slope(d, l) < 0 THEN -ln(2) / regr_slope(d, l) END, 4) AS half_life FROM ({step}) WHERE d IS NOT NULL GROUP BY a, b"""


def entropy(bins: int = 16) -> str:
    """Shannon entropy of returns in equal-width bins, in bits; the last bin is closed."""
    binned = f"SELECT symbol, CAST(least(floor((r - lo) / nullif(hi - lo, 0) * {bins}), {bins - 1}) AS INT) AS bin FROM (SELECT symbol, r, min(r) OVER (PARTITION BY symbol) AS lo, max(r) OVER (PARTITION BY symbol) AS hi FROM ({RETURNS}) WHERE r IS NOT NULL)"
    return f"SELECT symbol, round(-sum(p * ln(p) / ln(2)), 6) AS entropy, CAST(count(*) AS BIGINT) AS used FROM (SELECT symbol, bin, count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY symbol) AS p FROM ({binned}) GROUP BY symbol, bin) GROUP BY symbol"


def regimes() -> str:
    """Market regime of every bar from the 200th on, from `bars`: volatility above 40 percent a year first, then trends,
    strong ones where the directional index is above 25, else sideways; with confidence and the numbers behind it."""
    last = lambda agg, c, n: f"{agg}({c}) OVER ({DAY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    step = f"SELECT symbol, ts, close, high, low, row_number() OVER ({DAY}) AS rn, lag(close) OVER ({DAY}) AS pc, high - lag(high) OVER ({DAY}) AS up, lag(low) OVER ({DAY}) - low AS down FROM bars"
    step = f"SELECT *, close / nullif(pc, 0) - 1 AS r, CASE WHEN pc IS NULL THEN 0e0 ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, CASE WHEN up > down AND up > 0 THEN up ELSE 0e0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0e0 END AS minus, CASE WHEN close > pc THEN close - pc ELSE 0e0 END AS gain, CASE WHEN close < pc THEN pc - close ELSE 0e0 END AS loss FROM ({step})"
    step = f"SELECT *, {last('avg', 'close', 50)} AS m50, {last('avg', 'close', 200)} AS m200, {last('stddev_samp', 'r', 20)} * sqrt(252) AS volatility, 100 * {last('avg', 'plus', 14)} / ({last('avg', 'tr', 14)} + 1e-10) AS pdi, 100 * {last('avg', 'minus', 14)} / ({last('avg', 'tr', 14)} + 1e-10) AS mdi, {last('avg', 'gain', 14)} AS g, {last('avg', 'loss', 14)} AS l FROM ({step})"
    step = f"SELECT *, 100 * abs(pdi - mdi) / (pdi + mdi + 1e-10) AS dx, greatest(-1e0, least(1e0, 0.3e0 * (close - m50) / m50 + 0.3e0 * (close - m200) / m200 + 0.4e0 * (m50 - m200) / m200)) AS trend, CASE WHEN l = 0 THEN 100e0 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM ({step})"
    step = f"SELECT *, {last('avg', 'dx', 14)} AS adx FROM ({step})"
    regime = "CASE WHEN volatility > 0.4e0 THEN 'high_volatility' WHEN trend > 0.15e0 AND adx > 25 THEN 'strong_uptrend' WHEN trend > 0.05e0 THEN 'uptrend' WHEN trend < -0.15e0 AND adx > 25 THEN 'strong_downtrend' WHEN trend < -0.05e0 THEN 'downtrend' ELSE 'sideways' END"
    sure = "CASE WHEN regime = 'high_volatility' THEN 0.8e0 WHEN regime LIKE 'strong%' THEN least(0.9e0, 0.5e0 + abs(trend) + adx / 100) WHEN regime = 'sideways' THEN 0.7e0 ELSE least(0.85e0, 0.6e0 + abs(trend) * 2) END"
    return f"SELECT symbol, ts, r, regime, {sure} AS confidence, trend, volatility, rsi - 50 AS momentum, adx, rsi FROM (SELECT *, {regime} AS regime FROM ({step}) WHERE rn >= 200)"


def market_regimes() -> str:
    return f"SELECT symbol, ts, regime, {', '.join(f'round({c} + {NUDGE}, 5) + 0e0 AS {c}' for c in ('confidence', 'trend', 'volatility', 'momentum', 'adx', 'rsi'))} FROM ({regimes()})"


def transitions() -> str:
    step = f"SELECT symbol, regime, lead(regime) OVER ({DAY}) AS nxt FROM ({regimes()})"
    return f"SELECT symbol, regime, nxt, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1e0 / sum(count(*)) OVER (PARTITION BY symbol, regime), 6) AS p FROM ({step}) WHERE nxt IS NOT NULL GROUP BY symbol, regime, nxt"


def regime_stats() -> str:
    return f"SELECT symbol, regime, CAST(count(*) AS BIGINT) AS n, round(avg(r) * 252 + {NUDGE}, 5) AS annual, round(stddev_samp(r) * sqrt(252) + {NUDGE}, 5) AS vol FROM ({regimes()}) GROUP BY symbol, regime"


def forward_accuracy(n: int = 10) -> str:
    """Share of golden-cross-like signals whose sign the next n bars' return had, from `signals` (symbol, ts, close, signal)."""
    f = f"SELECT symbol, signal, signal * (lead(close, {n}) OVER ({DAY}) / nullif(close, 0) - 1) AS gain FROM signals"
    return f"SELECT symbol, CAST(count(gain) AS BIGINT) AS n, round(avg(CASE WHEN gain > 0 THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(gain), 6) AS mean_gain FROM ({f}) WHERE signal <> 0 AND gain IS NOT NULL GROUP BY symbol"


def factors() -> str:
    """Momentum and volatility factors of each symbol's returns."""
    m = lambda n: f"CASE WHEN count(r) OVER ({DAY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg(r) OVER ({DAY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
    return f"SELECT symbol, ts, round({m(252)} - {m(21)}, 6) AS momentum, round(-stddev_samp(r) OVER ({DAY} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 6) AS volatility FROM ({RETURNS})"


def _bin(c: str, bins: int, part: str) -> str:
    """Number of c's bin of equal width; the last is closed."""
    over = f"OVER (PARTITION BY {part})"
    return f"CAST(least(floor(({c} - min({c}) {over}) / nullif(max({c}) {over} - min({c}) {over}, 0) * {bins}), {bins - 1}) AS INT)"


def mutual_information(bins: int = 16) -> str:
    """Joint and conditional entropy and mutual information of two symbols' returns, in bits."""
    counted = f"SELECT a, b, bx, by_, count(*) AS c FROM (SELECT a, b, {_bin('x', bins, 'a, b')} AS bx, {_bin('y', bins, 'a, b')} AS by_ FROM ({PAIRS})) GROUP BY a, b, bx, by_"
    share = lambda more: f"sum(c) OVER (PARTITION BY a, b{more}) * 1e0 / sum(c) OVER (PARTITION BY a, b)"
    p = f"SELECT a, b, c * 1e0 / sum(c) OVER (PARTITION BY a, b) AS p, {share(', bx')} AS px, {share(', by_')} AS py FROM ({counted})"
    return f"SELECT a, b, round(-sum(p * ln(p)) / ln(2) + {NUDGE}, 5) AS joint_entropy, round(-sum(p * ln(p / px)) / ln(2) + {NUDGE}, 5) AS conditional_entropy, round(greatest(0e0, sum(p * ln(p / (px * py))) / ln(2)) + {NUDGE}, 5) AS mutual_information FROM ({p}) GROUP BY a, b"


def transfer_entropy(bins: int = 6, k: int = 1) -> str:
    """What one symbol's return k bars ago tells of another's beyond that one's own past, in bits, both ways."""
    ways = f"SELECT a AS source, b AS target, ts, x, y FROM ({PAIRS}) UNION ALL SELECT b, a, ts, y, x FROM ({PAIRS})"
    binned = f"SELECT source, target, ts, {_bin('x', bins, 'source, target')} AS bx, {_bin('y', bins, 'source, target')} AS y1 FROM ({ways})"
    past = f"SELECT source, target, y1, lag(y1, {k}) OVER (PARTITION BY source, target ORDER BY ts) AS y0, lag(bx, {k}) OVER (PARTITION BY source, target ORDER BY ts) AS x0 FROM ({binned})"
    counted = f"SELECT source, target, y1, y0, x0, count(*) AS c FROM ({past}) WHERE y0 IS NOT NULL AND x0 IS NOT NULL GROUP BY source, target, y1, y0, x0"
    n = lambda by: f"sum(c) OVER (PARTITION BY source, target{by}) * 1e0"
    p = f"SELECT source, target, c * 1e0 / {n('')} AS p, c * {n(', y0')} / ({n(', y0, x0')} * {n(', y1, y0')}) AS gain FROM ({counted})"
    return f"SELECT source, target, round(greatest(0e0, sum(p * ln(gain)) / ln(2)) + {NUDGE}, 5) AS transfer_entropy FROM ({p}) GROUP BY source, target"


def rolling_correlation(n: int = 60) -> str:
    w = f"OVER (PARTITION BY a, b ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"SELECT a, b, ts, CASE WHEN count(*) {w} = {n} THEN round(corr(x, y) {w} + {NUDGE}, 4) + 0e0 END AS corr FROM ({PAIRS})"


def spread_bands(n: int = 20, k: float = 2.0) -> str:
    """Log spread of two symbols, its z-score over n bars, and the band it is in."""
    w = f"OVER (PARTITION BY a, b ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    s = f"SELECT a, b, ts, s, CASE WHEN count(s) {w} = {n} THEN (s - avg(s) {w}) / nullif(stddev_samp(s) {w}, 0) END AS z FROM (SELECT a, b, ts, ln(va) - ln(vb) AS s FROM ({PAIRS}))"
    return f"SELECT a, b, ts, round(s + {NUDGE}, 5) AS spread, round(z + {NUDGE}, 4) AS z, CASE WHEN z > {k} THEN 'above' WHEN z < -{k} THEN 'below' WHEN z IS NOT NULL THEN 'inside' END AS band FROM ({s})"


def find_pairs(n: int = 5) -> str:
    """The pairs whose spread returns most surely."""
    return f"SELECT a, b, hedge, t_value, half_life FROM ({cointegration()}) ORDER BY t_value, a, b LIMIT {n}"


def volatility_classes(n: int = 20) -> str:
    """Returns by tercile of the symbol's own n-bar volatility."""
    v = f"SELECT symbol, r, CASE WHEN count(r) OVER ({DAY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN stddev_samp(r) OVER ({DAY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS vol FROM ({RETURNS})"
    cuts = f"SELECT symbol, percentile_cont(0.333333) WITHIN GROUP (ORDER BY vol) AS low, percentile_cont(0.666667) WITHIN GROUP (ORDER BY vol) AS high FROM ({v}) GROUP BY symbol"
    kind = "CASE WHEN vol <= low THEN 'calm' WHEN vol <= high THEN 'normal' ELSE 'wild' END"
    return f"SELECT t.symbol, {kind} AS kind, CAST(count(*) AS BIGINT) AS n, round(avg(r) * 252 + {NUDGE}, 6) AS annual, round(stddev_samp(r) * sqrt(252) + {NUDGE}, 6) AS volatility FROM ({v}) t JOIN ({cuts}) c ON t.symbol = c.symbol WHERE vol IS NOT NULL GROUP BY t.symbol, {kind}"


def diversification() -> str:
    """Of equal weights: mean volatility over the portfolio's, and the number of symbols."""
    own = f"SELECT stddev_samp(r) AS s FROM ({RETURNS}) WHERE r IS NOT NULL GROUP BY symbol"
    both = f"SELECT covar_samp(x, y) AS c FROM ({PAIRS}) GROUP BY a, b"
    return f"SELECT CAST(count(*) AS BIGINT) AS effective_n, round(sum(s) / nullif(sqrt(sum(s * s) + 2 * (SELECT coalesce(sum(c), 0) FROM ({both}))), 0) + {NUDGE}, 5) AS ratio FROM ({own})"


def price_regimes(n: int = 20) -> str:
    """Plain regimes: volatility above 40 percent a year, else the n-bar return above or below 5 percent."""
    base = f"SELECT symbol, ts, rn, stddev_pop(r) OVER ({DAY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) * sqrt(252) AS vol, value / nullif(lag(value, {n}) OVER ({DAY}), 0) - 1 AS move FROM ({RETURNS})"
    return f"SELECT symbol, ts, CASE WHEN vol > 0.4e0 THEN 'high_volatility' WHEN move > 0.05e0 THEN 'bull' WHEN move < -0.05e0 THEN 'bear' ELSE 'sideways' END AS regime FROM ({base}) WHERE rn > {n}"


def regime_forecast(steps: int = 3) -> str:
    """Chances of each regime some steps from each regime: the transition matrix multiplied by itself, as joins of its few rows."""
    one = transitions()
    q = f"SELECT symbol, regime, nxt, p FROM ({one})"
    for _ in range(steps - 1):
        q = f"SELECT x.symbol, x.regime, y.nxt, sum(x.p * y.p) AS p FROM ({q}) x JOIN ({one}) y ON x.symbol = y.symbol AND x.nxt = y.regime GROUP BY x.symbol, x.regime, y.nxt"
    return f"SELECT symbol, regime, nxt, round(p + {NUDGE}, 5) AS p FROM ({q})"


def regime_spells() -> str:
    """Lengths of unbroken runs of each regime."""
    marked = f"SELECT symbol, ts, regime, row_number() OVER ({DAY}) - row_number() OVER (PARTITION BY symbol, regime ORDER BY ts) AS run FROM ({regimes()})"
    return f"SELECT symbol, regime, CAST(count(*) AS BIGINT) AS spells, round(avg(len) + {NUDGE}, 4) AS mean_bars, CAST(max(len) AS BIGINT) AS longest FROM (SELECT symbol, regime, run, count(*) AS len FROM ({marked}) GROUP BY symbol, regime, run) GROUP BY symbol, regime"
