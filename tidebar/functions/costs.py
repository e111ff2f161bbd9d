"""Costs, fills and sizes as Column functions over order rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def commission_percent(value: Column, rate: float = 0.00015, least: float = 0.0) -> Column:
    return F.greatest(value * rate, F.lit(least))


def commission_fixed(fee: float = 5000.0) -> Column:
    return F.lit(fee)


#: Broker rates by channel and the tax on sales.
KOREA = {"mobile": 0.00015, "hts": 0.0005, "premium": 0.003}
KOREA_TAX = 0.0018


def commission_korea(value: Column, side: Column, channel: str = "mobile") -> Column:
    return value * KOREA[channel] + F.when(side == "SELL", value * KOREA_TAX).otherwise(0.0)


def commission_us(quantity: Column, value: Column, per_share: float = 0.005, least: float = 1.0, most: float = 0.01) -> Column:
    return F.least(F.greatest(quantity * per_share, F.lit(least)), value * most)


def sign(side: Column) -> Column:
    return F.when(side == "BUY", 1.0).otherwise(-1.0)


def slip_percent(price: Column, side: Column, rate: float = 0.001) -> Column:
    return price * (1 + sign(side) * rate)


def slip_fixed(price: Column, side: Column, amount: float = 10.0) -> Column:
    return price + sign(side) * amount


def slip_volume(price: Column, side: Column, quantity: Column, volume: Column, impact: float = 0.1, most: float = 0.02) -> Column:
    rate = F.when(volume <= 0, 0.01).otherwise(F.least(quantity / F.nullif(volume, F.lit(0.0)) * impact, F.lit(most)))
    return price * (1 + sign(side) * rate)


def slip_spread(price: Column, side: Column, spread: float) -> Column:
    return price * (1 + sign(side) * spread / 2)


def uniform(*key) -> Column:
    """A number in [0, 1) from a hash of the key: the same whatever the partitioning."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 53)) / float(1 << 53)


def slip_random(price: Column, side: Column, key: Column, most: float = 0.002, seed: int = 42) -> Column:
    return price * (1 + sign(side) * uniform(F.lit(seed), key) * most)


def fill(model: str, side: Column, kind: Column, limit: Column, key: Column | None = None) -> Column:
    """Price before slippage at a bar's open, high, low, close; limit orders give 0 where the bar doesn't reach them."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    buy = side == "BUY"
    market = {"close": c, "open": o, "vwap": (h + l + c) / 3, "worst": F.when(buy, h).otherwise(l), "best": F.when(buy, l).otherwise(h), "random": l + uniform(F.lit(42), key if key is not None else F.col("ts")) * (h - l)}[model]
    reached = F.when(buy, l <= limit).otherwise(h >= limit)
    at_limit = F.when(buy, F.least(market, limit)).otherwise(F.greatest(market, limit))
    return F.when(kind != "LIMIT", market).when(reached, at_limit).otherwise(0.0)


def impact(model: str, share: Column, daily_vol: Column, eta: float = 0.1) -> Column:
    """Market impact as a fraction of price, by share of the volume."""
    return {"none": F.lit(0.0), "linear": eta * share, "sqrt": eta * F.sqrt(share), "almgren": eta * daily_vol * F.sqrt(share)}[model]


def fill_ratio(share: Column) -> Column:
    return F.when(share <= 0.01, 1.0).when(share <= 0.05, 0.95).when(share <= 0.1, 0.85).when(share <= 0.2, 0.7).otherwise(0.5)


def size_amount(price: Column, amount: float) -> Column:
    return F.floor(F.lit(amount) / price)


def size_percent(price: Column, equity: Column, percent: float = 0.95) -> Column:
    return F.floor(equity * percent / price)


def size_risk(price: Column, stop: Column, equity: Column, risk: float = 0.02) -> Column:
    return F.floor(equity * risk / F.nullif(F.abs(price - stop), F.lit(0.0)))


def size_kelly(price: Column, equity: Column, n: Column, win_rate: Column, win: Column, loss: Column, part: float = 0.5, most: float = 0.25, default: float = 0.1) -> Column:
    """Half the Kelly fraction from 20 trades on with wins and losses among them, a tenth before."""
    f = F.least(F.greatest((win_rate - (1 - win_rate) / F.nullif(win / F.nullif(loss, F.lit(0.0)), F.lit(0.0))) * part, F.lit(0.0)), F.lit(most))
    share = F.when((n >= 20) & (win > 0) & (loss > 0), f).otherwise(default)
    return F.floor(equity * share / price)


def size_volatility(price: Column, equity: Column, atr: Column, risk: float = 0.02, k: float = 2.0) -> Column:
    return F.least(F.floor(equity * risk / F.nullif(atr * k, F.lit(0.0))), F.floor(equity / price))
