"""Paginated feeds as a data source: a partition a page, fetched where it is read.

    spark.dataSource.register(PagedFeed)
    spark.read.format("bar_pages").option("fetch", "package.module:function").option("symbol", "S").option("start", "2024-01-01").option("end", "2024-12-31").option("days", 100).load()

fetch(symbol, first day, last day) gives rows (symbol, ts, open, high, low, close, volume); pages may overlap or repeat rows,
which `bars.conform` or `bars.upserted` resolve.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass
class Page(InputPartition):
    first: dt.date
    last: dt.date


class PagedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bar_pages"

    def schema(self) -> str:
        return "symbol string, ts timestamp, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.symbol, self.fetch = options["symbol"], options["fetch"]
        self.start, self.end = (dt.date.fromisoformat(options[k]) for k in ("start", "end"))
        self.days = int(options.get("days", "500"))

    def partitions(self) -> list[Page]:
        step = dt.timedelta(self.days)
        pages, first = [], self.start
        while first <= self.end:
            pages.append(Page(first, min(first + step - dt.timedelta(1), self.end)))
            first += step
        return pages

    def read(self, page: Page) -> Iterator[tuple]:
        module, function = self.fetch.split(":")
        yield from getattr(import_module(module), function)(self.symbol, page.first, page.last)


def sample(symbol: str, first: dt.date, last: dt.date) -> Iterator[tuple]:
    """Made-up bars, the same whenever they are asked for: a feed for trials without a network."""
    day = first
    while day <= last:
        shift = int.from_bytes(hashlib.sha256(f"{symbol}{day}".encode()).digest()[:4], "big") / 2**32 - 0.5
        close = 100 * math.exp(0.2 * math.sin(day.toordinal() / 50)) + shift
        yield symbol, dt.datetime.combine(day, dt.time()), close - shift, close + abs(shift), close - 2 * abs(shift), close, 1000.0 + 100 * shift
        day += dt.timedelta(1)
