"""Operators as steps of SQL expressions over ordered bars.

A step adds columns; a later step may use an earlier one's. Spark plans the steps with selectExpr, so all windows of a
step share one sort; the same text runs in other SQL engines, which is how the operators are verified.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

KEY, TIME = "symbol", "ts"
OVER = f"PARTITION BY {KEY} ORDER BY {TIME}"


def query(text: str, **frames: DataFrame) -> DataFrame:
    """Runs SQL over frames by the names that the text gives them; no view of the session's is touched."""
    text = text.replace("{", "{{").replace("}", "}}")
    for name in frames:
        text = re.sub(rf"\b{name}\b", f"{{{name}}}", text)
    return next(iter(frames.values())).sparkSession.sql(text, **frames)


def frame(n: int) -> str:
    return f"OVER ({OVER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int) -> str:
    """Aggregate of the last n rows; null until n values are there."""
    return f"CASE WHEN count({x}) {frame(n)} = {n} THEN {agg}({x}) {frame(n)} END"


def cum(agg: str, x: str) -> str:
    return f"{agg}({x}) OVER ({OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def prior(agg: str, x: str, n: int) -> str:
    """Aggregate of the n rows before this one."""
    return f"CASE WHEN count({x}) OVER ({OVER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN {agg}({x}) OVER ({OVER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({OVER})"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER ({OVER})"


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def weighted(x: str, weights: list[float]) -> str:
    """Weighted mean of the last rows, weights from the oldest to this one; null until all are there."""
    n, total = len(weights), sum(weights)
    return "(" + " + ".join(f"{w / total!r} * {x if i == n - 1 else lag(x, n - 1 - i)}" for i, w in enumerate(weights)) + ")"


@dataclass(frozen=True)
class Spec:
    """steps: dicts of column -> expression; out: columns of the result; digits: decimals to which results are compared."""

    steps: tuple[dict[str, str], ...]
    out: tuple[str, ...]
    guard: int = 1
    digits: int = 4


#: Added before rounding, so that exact halves, which engines round differently, aren't met.
NUDGE = "0.00000137"
ROW = {"rn": f"row_number() OVER ({OVER})"}


def apply(bars: DataFrame, spec: Spec) -> DataFrame:
    """bars with the spec's columns."""
    df = bars
    for step in (ROW, *spec.steps):
        df = df.selectExpr("*", *[f"{e} AS {c}" for c, e in step.items()])
    guarded = [f"CASE WHEN rn >= {spec.guard} THEN {c} END AS {c}" if spec.guard > 1 else c for c in spec.out]
    return df.selectExpr(*bars.columns, *guarded)


def rounded(df: DataFrame, spec: Spec) -> DataFrame:
    return df.selectExpr(KEY, TIME, *[f"round(CAST({c} AS DOUBLE) + {NUDGE}, {spec.digits}) AS {c}" for c in spec.out])


def sql(source: str, spec: Spec) -> str:
    """The same as apply() and rounded() over a source query, as one SQL text; 0e0 makes a negative zero plain."""
    q = source
    for step in (ROW, *spec.steps):
        q = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in step.items())} FROM ({q})"
    value = lambda c: f"CASE WHEN rn >= {spec.guard} THEN {c} END" if spec.guard > 1 else c
    return f"SELECT {KEY}, {TIME}, {', '.join(f'round(CAST({value(c)} AS DOUBLE) + {NUDGE}, {spec.digits}) + 0e0 AS {c}' for c in spec.out)} FROM ({q})"
