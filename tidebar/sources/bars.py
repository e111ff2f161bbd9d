"""Bars: a long table (symbol, ts, open, high, low, close, volume), from tables, files, ticks and other bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("open", "high", "low", "close")
BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in (*PRICES, "volume")]])
#: Timeframe names and the durations that window() takes.
TIMEFRAMES = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour", "4h": "4 hours", "D": "1 day", "1d": "1 day", "W": "7 days", "1w": "7 days"}


def conform(df: DataFrame, symbol: str | None = None) -> DataFrame:
    """Bars from any table with a close: names in lower case, volume 0 and prices the close where absent, NaN to null, rows without close dropped."""
    names = {c.lower(): c for c in df.columns}
    ts = next(names[c] for c in ("ts", "date", "datetime", "timestamp") if c in names)
    close = F.col(names["close"]).cast("double")
    number = lambda c, other: F.nanvl(F.col(names[c]).cast("double"), F.lit(None).cast("double")) if c in names else other
    sym = F.col(names["symbol"]) if "symbol" in names and symbol is None else F.lit(symbol or "")
    out = df.select(sym.cast("string").alias("symbol"), F.col(ts).cast("timestamp").alias("ts"), *[number(c, close).alias(c) for c in PRICES], number("volume", F.lit(0.0)).alias("volume"))
    return out.dropna(subset=["ts", *PRICES])


def from_ticks(ticks: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, *order: Column) -> DataFrame:
    """Bars of the ticks that share symbol and ts; open and close are the first and last tick by `order`. One partial aggregate, one shuffle of the bars."""
    key = F.struct(*order)
    t = ticks.select(symbol.alias("symbol"), ts.cast("timestamp").alias("ts"), price.alias("price"), volume.alias("v"), key.alias("key"))
    return t.groupBy("symbol", "ts").agg(F.min_by("price", "key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "key").alias("close"), F.sum("v").cast("double").alias("volume"))


def read(spark: SparkSession, path: str, fmt: str = "parquet", symbol: str | None = None, **options) -> DataFrame:
    """Bars from Parquet, ORC, CSV or JSON files."""
    return conform(spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}), **options).load(path), symbol)


def li_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = [c(x) for x in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]
    return from_ticks(rows, F.concat_ws("-", "l_returnflag", "l_linestatus"), F.date_trunc("day", "l_shipdate"), c("l_extendedprice") / c("l_quantity"), c("l_quantity"), *order)


def ord_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return from_ticks(rows, F.col("o_orderpriority"), F.date_trunc("day", "o_orderdate"), F.col("o_totalprice"), F.lit(1.0), F.col("o_orderkey"), F.col("o_totalprice"))


def ev_bars(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL")
    return from_ticks(rows, F.col("event_type"), F.date_trunc(unit, "ts"), F.col("value"), F.lit(1.0), F.col("ts"), F.col("event_id"))


def bucket(ts: Column, rule: str) -> Column:
    """Label of the week (its Sunday) or month (its last day), or the start of a timeframe."""
    if rule in ("W", "1w"):
        return F.next_day(F.date_sub(F.to_date(ts), 1), "SUN").cast("timestamp")
    if rule == "M":
        return F.last_day(ts).cast("timestamp")
    return F.window(ts, TIMEFRAMES[rule]).start


def resample(bars: DataFrame, rule: str) -> DataFrame:
    return bars.groupBy("symbol", bucket(F.col("ts"), rule).alias("ts")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))


def align(bars: DataFrame, how: str = "inner", fill: str = "ffill", first: str | None = None) -> DataFrame:
    """All symbols on one calendar: dates of all (inner), of any (outer) or of one symbol (left); gaps filled, dropped or zero. Long form: no column a symbol."""
    symbols = bars.select("symbol").distinct()
    dates = bars.groupBy("ts").agg(F.count_distinct("symbol").alias("n"))
    if how == "inner":
        total = symbols.agg(F.count("*").alias("total"))
        dates = dates.join(F.broadcast(total), F.col("n") == F.col("total"))
    elif how == "left":
        dates = bars.where(F.col("symbol") == F.lit(first)).select("ts").distinct()
    grid = dates.select("ts").join(F.broadcast(symbols), how="cross")  # a row a symbol on one side
    out = grid.join(bars, ["symbol", "ts"], "left")
    values = [*PRICES, "volume"]
    if fill == "ffill":
        w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        out = out.select("symbol", "ts", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in values])
    elif fill == "zero":
        out = out.fillna(0.0, subset=values)
    return (out.dropna(subset=values) if fill in ("drop", "ffill") else out).select("symbol", "ts", *values)


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bars of both; of two with one symbol and ts the newer stays."""
    both = old.withColumn("src", F.lit(0)).unionByName(new.withColumn("src", F.lit(1)))
    rest = F.struct("src", *PRICES, "volume")
    return both.groupBy("symbol", "ts").agg(F.max(rest).alias("r")).select("symbol", "ts", *[F.col(f"r.{c}").alias(c) for c in (*PRICES, "volume")])


class Cache:
    """Bars kept as Parquet by symbol in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def get(self, symbol: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        df = self.spark.read.schema(BARS).parquet(self.path)
        for cond in (F.col("symbol") == symbol if symbol else None, F.col("ts") >= start if start else None, F.col("ts") <= end if end else None):
            df = df if cond is None else df.where(cond)
        return df

    def save(self, bars: DataFrame, merge: bool = True) -> None:
        """Writes the partitions of the symbols in `bars`, each merged with what is there."""
        names = bars.select("symbol").distinct()
        try:
            old = self.get().join(names, "symbol", "left_semi") if merge else None
        except Exception as e:  # nothing kept yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = None
        out = upserted(old, bars.select(BARS.names)) if old is not None else bars.select(BARS.names)
        (out.checkpoint() if old is not None else out).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(self.path)

    def info(self) -> DataFrame:
        return self.get().groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))

    def files(self) -> DataFrame:
        """Size and age of what is kept."""
        m = self.spark.read.parquet(self.path).select("symbol", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        return m.groupBy("symbol").agg(F.sum("file_size").alias("bytes"), F.max("file_modification_time").alias("changed"))

    def stale(self, days: float) -> DataFrame:
        return self.files().where(F.col("changed") < F.current_timestamp() - F.expr(f"INTERVAL {int(days * 86400)} SECONDS")).select("symbol")

    def complete(self, start: str, end: str, slack_days: int = 5) -> DataFrame:
        """Whether each symbol covers the range: from start on, up to `slack_days` before the end or today."""
        until = F.date_sub(F.least(F.to_date(F.lit(end)), F.current_date()), slack_days)
        return self.info().select("symbol", ((F.to_date("first") <= F.to_date(F.lit(start))) & (F.to_date("last") >= until)).alias("complete"))

    def missing_from(self) -> DataFrame:
        """The day from which an incremental refresh has to fetch."""
        return self.info().select("symbol", F.date_add(F.to_date("last"), 1).alias("from_day"))

    def delete(self, symbols: list[str]) -> None:
        keep = self.get().where(~F.col("symbol").isin(symbols)).checkpoint()
        keep.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("symbol").parquet(self.path)


def paged(pages: list[DataFrame], start: str, end: str) -> DataFrame:
    """Pages of a paginated feed as one table: of repeated bars the last page's, in range."""
    numbered = [p.withColumn("page", F.lit(i)) for i, p in enumerate(pages)]
    rows = reduce(DataFrame.unionByName, numbered)
    newest = rows.groupBy("symbol", "ts").agg(F.max(F.struct("page", *PRICES, "volume")).alias("r"))
    return newest.select("symbol", "ts", *[F.col(f"r.{c}").alias(c) for c in (*PRICES, "volume")]).where(F.col("ts").between(start, end))
