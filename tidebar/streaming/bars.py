"""Bars from a stream of ticks, and causal indicators with constant state a symbol."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def bars(ticks: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """Bars of ticks (symbol, ts, price, volume, seq); ticks later than the watermark are dropped. In batch the same plan gives the same bars."""
    key = F.struct("ts", "seq")
    g = ticks.withWatermark("ts", late).groupBy(F.window("ts", every), "symbol")
    out = g.agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def sessions(ticks: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Trading sessions: ticks with no longer gap between them."""
    g = ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "symbol")
    return g.agg(F.count("*").alias("ticks"), F.sum("volume").alias("volume")).select("symbol", F.col("session_window.start").alias("start_ts"), F.col("session_window.end").alias("end_ts"), "ticks", "volume")


def indicators(bar_stream: DataFrame, fast: int = 12, slow: int = 26) -> DataFrame:
    """Exponential means of closes and their cross as bars arrive (in order a symbol); state: two means and a count."""
    a, b = 2 / (fast + 1), 2 / (slow + 1)

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, f, s = state.get if state.exists else (0, 0.0, 0.0)
        rows = []
        for pdf in frames:
            for ts, c in pdf.sort_values("ts")[["ts", "close"]].itertuples(index=False):
                above = f > s
                f, s = (c, c) if n == 0 else (f + a * (c - f), s + b * (c - s))
                n += 1
                signal = 0 if n <= slow or above == (f > s) else 1 if f > s else -1
                rows.append((key[0], ts, c, f, s, signal))
        state.update((n, f, s))
        yield pd.DataFrame(rows, columns=["symbol", "ts", "close", "fast", "slow", "signal"])

    return bar_stream.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, close double, fast double, slow double, signal int", "n long, f double, s double", "append", GroupStateTimeout.NoTimeout)
