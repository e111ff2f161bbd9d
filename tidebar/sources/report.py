"""A report as one HTML file: small result tables and lines, drawn without libraries."""

from __future__ import annotations

from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thinned(series: DataFrame, points: int = 400) -> DataFrame:
    """The last value of each of so many spans of time a symbol, so that what is drawn stays small whatever the input."""
    ends = series.groupBy("symbol").agg(F.min("ts").alias("since"), F.max("ts").alias("until"))
    at, since, until = (F.unix_timestamp(c) for c in ("ts", "since", "until"))
    span = F.least(F.floor((at - since) / F.greatest(until - since, F.lit(1)) * points), F.lit(points - 1))
    j = series.join(ends, "symbol").withColumn("span", span)
    return j.groupBy("symbol", "span").agg(F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value")).drop("span")


def line(values: list[float], width: int = 720, height: int = 160) -> str:
    """An SVG line through the values."""
    low, high = min(values), max(values)
    across, up = width / max(len(values) - 1, 1), height / ((high - low) or 1)
    points = " ".join(f"{i * across:.1f},{height - (v - low) * up:.1f}" for i, v in enumerate(values))
    return f'<svg viewBox="0 0 {width} {height}" width="{width}"><polyline fill="none" stroke="currentColor" points="{points}"/></svg>'


def table(rows: pd.DataFrame) -> str:
    return rows.to_html(index=False, border=0, escape=True, float_format=lambda v: f"{v:,.4f}")


def html(title: str, series: DataFrame, tables: dict[str, DataFrame], rows: int = 200) -> str:
    """Lines of a series (symbol, ts, value) and the first rows of each table."""
    drawn = thinned(series).toPandas().sort_values(["symbol", "ts"])
    lines = [f"<h2>{escape(str(s))}</h2>{line(g.value.tolist())}" for s, g in drawn.groupby("symbol")]
    shown = [f"<h2>{escape(k)}</h2>{table(df.limit(rows).toPandas())}" for k, df in tables.items()]
    return f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1>{''.join(lines + shown)}"
