"""Parameter grids, sweeps, walk-forward folds, Monte Carlo: runs as rows."""

from __future__ import annotations

import datetime as dt
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.functions.costs import uniform
from tidebar.operators import simulate
from tidebar.operators.simulate import METRICS, Rules


def int_range(low: int, high: int, step: int = 1) -> list[int]:
    return list(range(low, high + 1, step))


def float_range(low: float, high: float, step: float) -> list[float]:
    return [round(low + i * step, 6) for i in range(int((high - low) / step + 0.5) + 1)]


def grid(spark: SparkSession, space: dict[str, list], where: str | None = None) -> DataFrame:
    """run_id and the parameters of every combination, in order."""
    rows = [(i, *r) for i, r in enumerate(product(*space.values()))]
    df = spark.createDataFrame(rows, ["run_id", *space])
    return df.where(where) if where else df


def random_sample(spark: SparkSession, space: dict[str, list], n: int, seed: int = 42) -> DataFrame:
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, *[v[int(rng.integers(len(v)))] for v in space.values()]) for i in range(n)], ["run_id", *space])


def ranked(results: DataFrame, metric: str = "sharpe", n: int = 10, lowest: bool = False) -> DataFrame:
    """The n best runs a symbol (drawdown: the smallest)."""
    key = F.abs(metric).asc() if metric == "max_drawdown" else F.col(metric).asc_nulls_last() if lowest else F.col(metric).desc_nulls_last()
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(key, "run_id"))).where(F.col("rank") <= n)


def summary(results: DataFrame, metric: str = "sharpe") -> DataFrame:
    m = F.col(metric)
    return results.groupBy("symbol").agg(F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"), F.min(m).alias("min"), F.max(m).alias("max"), F.median(m).alias("median"), F.avg((m > 0).cast("double")).alias("positive"))


def _months(d: dt.date, n: int) -> dt.date:
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    last = [31, 29 if y % 4 == 0 and (y % 100 or y % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][m]
    return dt.date(y, m + 1, min(d.day, last))


def folds(start: dt.date, end: dt.date, train: int = 12, test: int = 3, step: int | None = None, anchored: bool = False) -> list[tuple[int, dt.date, dt.date, dt.date, dt.date]]:
    """(fold, train start, train end, test start, test end) by months; ends are exclusive; the last test is cut at `end`."""
    out, at = [], start
    while (cut := _months(at, train)) < end:
        out.append((len(out), start if anchored else at, cut, cut, min(_months(cut, test), end)))
        at = _months(at, step or test)
    return out


def kfold(start: dt.date, end: dt.date, k: int = 5) -> list[tuple[int, dt.date, dt.date, dt.date, dt.date]]:
    edges = [start + (end - start) * i / (k + 1) for i in range(k + 2)]
    return [(i, start, edges[i + 1], edges[i + 1], edges[i + 2]) for i in range(k)]


def walk_forward(bars: DataFrame, fold_rows: list[tuple], params: DataFrame, strategy: str, metric: str = "sharpe", rules: Rules = Rules()) -> DataFrame:
    """Per symbol and fold: the best run in training and how it did out of sample.

    One plan for all folds: bars meet the folds' ranges (a bounded table), the sweep runs by (symbol|fold|phase), a window picks the best."""
    spark = bars.sparkSession
    f = spark.createDataFrame([(i, p, s, e) for i, a, b, c, d in fold_rows for p, s, e in (("is", a, b), ("oos", c, d))], "fold int, phase string, s date, e date")
    day = F.to_date("ts")
    split = bars.join(F.broadcast(f), (day >= F.col("s")) & (day < F.col("e"))).withColumn("symbol", F.concat_ws("|", "symbol", F.col("fold").cast("string"), "phase")).drop("fold", "phase", "s", "e")
    res = simulate.sweep(split, params, strategy, rules)
    parts = F.split("symbol", r"\|")
    res = res.select(parts[0].alias("symbol"), parts[1].cast("int").alias("fold"), parts[2].alias("phase"), "run_id", F.coalesce(F.nanvl(F.col(metric), F.lit(None)), F.lit(0.0)).alias("m"))
    best = res.where("phase = 'is'").withColumn("k", F.row_number().over(Window.partitionBy("symbol", "fold").orderBy(F.col("m").desc(), "run_id"))).where("k = 1")
    oos = res.where("phase = 'oos'").select("symbol", "fold", "run_id", F.col("m").alias("oos"))
    return best.select("symbol", "fold", "run_id", F.col("m").alias("in_sample")).join(oos, ["symbol", "fold", "run_id"], "left").select("symbol", "fold", "run_id", "in_sample", F.coalesce("oos", F.lit(0.0)).alias("out_of_sample"))


def robustness(results: DataFrame) -> DataFrame:
    """Averages in and out of sample, their ratio, share of positive folds, the most frequent run."""
    r = results.groupBy("symbol").agg(F.avg("in_sample").alias("in_sample"), F.avg("out_of_sample").alias("out_of_sample"), F.avg((F.col("out_of_sample") > 0).cast("double")).alias("positive"), F.mode("run_id", True).alias("run_id"))
    ratio = F.col("out_of_sample") / F.nullif(F.col("in_sample"), F.lit(0.0))
    return r.withColumn("robustness", ratio).withColumn("verdict", F.when(ratio >= 0.8, "robust").when(ratio >= 0.5, "fair").when(ratio >= 0.3, "weak").otherwise("overfit"))


def bootstrap(returns: DataFrame, paths: int = 1000, steps: int = 252, seed: int = 42) -> DataFrame:
    """Resampled paths of returns (symbol, k, r; k = 0 .. n - 1): final value and drawdown of each. Draws are hashes of (seed, symbol, path, step): the same whatever the partitioning."""
    n = returns.groupBy("symbol").agg(F.count("*").alias("n"))
    draws = n.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).repartition("symbol", "path").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    draws = draws.withColumn("k", F.floor(uniform(F.lit(seed), "symbol", "path", "step") * F.col("n")))
    return _walked(draws.join(returns, ["symbol", "k"]))


def _walked(draws: DataFrame) -> DataFrame:
    """Final value and deepest fall of each path of returns (symbol, path, step, r)."""
    w = Window.partitionBy("symbol", "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    p = draws.withColumn("v", F.exp(F.sum(F.log1p(F.greatest("r", F.lit(-0.999999)))).over(w)))
    p = p.withColumn("dd", F.col("v") / F.greatest(F.max("v").over(w), F.lit(1.0)) - 1)
    return p.groupBy("symbol", "path").agg(F.max_by("v", "step").alias("final"), F.min("dd").alias("max_drawdown"))


def gaussian(moments: DataFrame, paths: int = 1000, steps: int = 252, seed: int = 42) -> DataFrame:
    """Paths of normal returns with each symbol's mean and deviation (symbol, mean, std); draws are hashes, as in bootstrap."""
    draws = moments.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).repartition("symbol", "path").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    u, v = (uniform(F.lit(seed + i), "symbol", "path", "step") for i in (0, 1))
    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v)
    return _walked(draws.select("symbol", "path", "step", (F.col("mean") + F.col("std") * normal).alias("r")))


def simulated_risk(paths: DataFrame, q: float = 0.05) -> DataFrame:
    """Value at risk of the paths' final values, and the mean beyond it."""
    cut = paths.groupBy("symbol").agg(F.percentile("final", F.lit(q)).alias("cut"))
    j = paths.join(cut, "symbol")
    return j.groupBy("symbol").agg((F.first("cut") - 1).alias("var"), (F.avg(F.when(F.col("final") <= F.col("cut"), F.col("final"))) - 1).alias("cvar"), F.avg("max_drawdown").alias("max_drawdown"))


def bands(paths: DataFrame) -> DataFrame:
    q = lambda p: F.percentile("final", F.lit(p))
    return paths.groupBy("symbol").agg(*[q(p / 100).alias(f"p{p}") for p in (1, 5, 25, 50, 75, 95, 99)], F.avg((F.col("final") < 0.5).cast("double")).alias("ruin"), F.avg("max_drawdown").alias("max_drawdown"))
