"""Names and values as SQL text, for engines that are given text: JDBC sources and the DuckDB twin."""

from __future__ import annotations

import re
from datetime import UTC, date, datetime
from decimal import Decimal
from typing import Any

WATERMARK = re.compile(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,7})?")
_QUOTES = {"spark": ("`", "`"), "duckdb": ('"', '"'), "ansi": ('"', '"'), "tsql": ("[", "]")}


def name(text: str, dialect: str = "ansi") -> str:
    """A quoted identifier; a dotted one is quoted part by part for sources that are addressed so."""
    if dialect not in _QUOTES:
        raise ValueError(f"unknown dialect '{dialect}'")
    opening, closing = _QUOTES[dialect]
    parts = text.split(".") if dialect in ("ansi", "tsql") else [text]
    return ".".join(opening + part.replace(closing, closing * 2) + closing for part in parts)


def number(value: float | int | Decimal) -> str:
    """Fixed point, as exponents make doubles of decimals."""
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        raise ValueError(f"{value} is no number to compare with")
    return format(Decimal(str(value)), "f")


def timestamp(value: datetime) -> str:
    """UTC; a time without a zone is taken as UTC."""
    return (value.astimezone(UTC) if value.tzinfo else value).strftime("%Y-%m-%d %H:%M:%S.%f")


def literal(value: Any, dialect: str = "ansi") -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float, Decimal)):
        return number(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP '{timestamp(value)}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    text = str(value)
    if dialect == "spark":
        text = text.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + (text if dialect == "spark" else text.replace("'", "''")) + "'"


def watermark(value: str, dialect: str = "ansi") -> str:
    """A watermark as a timestamp literal, in JDBC's own notation unless told otherwise; anything but a timestamp's text is refused."""
    if not WATERMARK.fullmatch(value):
        raise ValueError(f"refusing malformed watermark {value!r}")
    return f"CAST('{value}' AS DATETIME2(7))" if dialect == "tsql" else f"{{ts '{value}'}}"
