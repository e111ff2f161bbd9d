"""Limits of risk over a stream of orders, as SQL that Spark and other engines run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Shares of equity, positions held at once, orders a day; drawdown from the peak and the day's loss."""

    position: float = 0.2
    exposure: float = 1.0
    drawdown: float = 0.15
    day_loss: float = 0.03
    positions: int = 10
    orders: int = 50


#: Fixed values.
PRESETS = {"conservative": Limits(0.1, 0.8, 0.1, 0.02, 5), "moderate": Limits(0.2, 1.0, 0.15, 0.03, 10), "aggressive": Limits(0.3, 1.5, 0.25, 0.05, 20)}


def verdict(limits: Limits = Limits()) -> str:
    """The first limit that an order breaks, or ok.

    Columns: side, value; equity, peak and day_start (equity's highest, and at the day's start); nth (order of the day);
    open_positions, own (value held in the order's symbol), held (in all). What is held bounds purchases only."""
    buy = "side = 'BUY' AND"
    rules = {
        "orders": f"nth > {limits.orders}",
        "positions": f"{buy} own = 0 AND open_positions >= {limits.positions}",
        "position": f"{buy} own + value > equity * {limits.position!r}",
        "exposure": f"{buy} held + value > equity * {limits.exposure!r}",
        "drawdown": f"peak > 0 AND peak - equity >= peak * {limits.drawdown!r}",
        "day_loss": f"day_start > 0 AND day_start - equity >= day_start * {limits.day_loss!r}",
    }
    return "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for name, cond in rules.items()) + " ELSE 'ok' END"
