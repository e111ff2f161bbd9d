"""Periods, cash and names as users write them; driver-side."""

from __future__ import annotations

import datetime as dt
import re

#: Days a unit stands for, and factors of number words. Fixed values.
DAYS = {"년": 365, "개월": 30, "일": 1}
MONEY = {"억": 100_000_000, "천만": 10_000_000, "백만": 1_000_000, "만": 10_000}
SYMBOLS = {"삼성전자": "005930", "SK하이닉스": "000660", "네이버": "035420", "카카오": "035720", "현대차": "005380", "애플": "AAPL", "테슬라": "TSLA"}


def period(text: str, today: dt.date | None = None) -> tuple[str, str]:
    """'3년', '6개월', '30일' up to today, or 'a~b'."""
    today = today or dt.date.today()
    if "~" in text:
        a, b = (x.strip() for x in text.split("~", 1))
        return a, b or today.isoformat()
    if not (m := re.fullmatch(r"\s*(\d+)\s*(년|개월|일)\s*", text)):
        raise ValueError(f"not a period: {text!r}")
    return (today - dt.timedelta(days=int(m[1]) * DAYS[m[2]])).isoformat(), today.isoformat()


def cash(value: str | float) -> float:
    """'1000만원', '1억', '천만', 5000."""
    if not isinstance(value, str):
        return float(value)
    text = value.replace(",", "").replace("원", "").strip()
    for word, factor in MONEY.items():
        if text.endswith(word):
            return float(text[: -len(word)] or 1) * factor
    return float(text)


def symbol(name: str) -> str:
    return SYMBOLS.get(name, name)
