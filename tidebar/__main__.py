"""python -m tidebar list | backtest | optimize | compare: thin commands over files of bars."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from tidebar.functions import text
from tidebar.operators import simulate
from tidebar.operators.simulate import Rules
from tidebar.plans import presets, search
from tidebar.sources import bars as sources


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidebar")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of presets and sweepable strategies")
    for name in ("backtest", "compare", "optimize"):
        c = sub.add_parser(name)
        c.add_argument("path", help="Parquet, ORC, CSV or JSON files with bars")
        c.add_argument("--format", default="parquet")
        c.add_argument("--cash", default="10000000", help="a number, or as written in Korean")
        c.add_argument("--strategy", action="append", default=[], help="preset; for optimize, a sweepable strategy")
        c.add_argument("--out", help="folder for the result as Parquet; printed otherwise")
        if name == "optimize":
            c.add_argument("--param", action="append", default=[], help="name=low:high:step, or name=a,b,c")
            c.add_argument("--metric", default="sharpe", choices=simulate.METRICS)
    return p


def domain(value: str) -> list:
    """low:high:step (whole or not), or a list."""
    number = lambda x: int(x) if x.lstrip("-").isdigit() else float(x)
    if ":" not in value:
        return [number(x) for x in value.split(",")]
    low, high, step = (*map(number, value.split(":")), 1)[:3]
    return search.int_range(low, high, step) if all(isinstance(x, int) for x in (low, high, step)) else search.float_range(low, high, step)


def result(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    bars, cash = sources.read(spark, args.path, args.format), text.cash(args.cash)
    if args.command == "optimize":
        grid = search.grid(spark, {k: domain(v) for k, v in (x.split("=", 1) for x in args.param)})
        return search.ranked(simulate.sweep(bars, grid, (args.strategy or ["goldenCross"])[0], Rules(cash=cash)), args.metric)
    from pyspark.sql import functions as F

    runs = [presets.run(bars, n, Rules(cash=cash, fill="open")).withColumn("strategy", F.lit(n)) for n in args.strategy or ["goldenCross"]]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.orderBy("symbol", F.col("sharpe").desc())


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "list":
        print("presets:", *presets.PRESETS, "\nsweepable:", *simulate.STRATEGIES)
        return
    spark = SparkSession.builder.appName("tidebar").getOrCreate()
    df = result(spark, args)
    df.write.mode("errorifexists").parquet(args.out) if args.out else df.show(100, truncate=False)


if __name__ == "__main__":
    main()
