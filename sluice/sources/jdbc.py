"""Incremental reads of a database table over JDBC.

The window's bounds are part of the query that the database runs; within the
window, a table with a whole-number key is read by several tasks.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import text
from sluice.plans.spec import Feed
from sluice.plans.state import Window

PREFIX = "SLUICE_CONN_"


@dataclass(frozen=True)
class Connection:
    url: str
    user: str = ""
    password: str = field(default="", repr=False)
    driver: str | None = None
    dialect: str = "ansi"

    @classmethod
    def from_env(cls, name: str) -> Connection:
        """SLUICE_CONN_<NAME>_URL, _USER, _PASSWORD, _DRIVER, _DIALECT."""
        get = lambda k, default="": os.environ.get(f"{PREFIX}{name.upper()}_{k}", default)
        if not get("URL"):
            raise KeyError(f"environment variable {PREFIX}{name.upper()}_URL is not set")
        return cls(get("URL"), get("USER"), get("PASSWORD"), get("DRIVER") or None, get("DIALECT", "ansi"))


def _reader(spark: SparkSession, conn: Connection, fetch_size: int):
    options = {"url": conn.url, "user": conn.user, "password": conn.password, "driver": conn.driver, "fetchsize": str(fetch_size)}
    return spark.read.format("jdbc").options(**{k: v for k, v in options.items() if v})


def predicate(feed: Feed, window: Window, dialect: str = "ansi") -> str:
    """Rows above the window's low bound, if it has one, up to its high bound."""
    column = text.name(feed.mark, dialect)
    bounds = [f"{column} > {text.watermark(window.low, dialect)}"] if window.low is not None else []
    return " AND ".join([*bounds, f"{column} <= {text.watermark(window.high, dialect)}"])


def in_window(column: str, low: str | None, high: str, kind: str = "timestamp"):
    """The same for a DataFrame, where it is pushed into the scan."""
    c = F.col(column)
    return c <= F.lit(high).cast(kind) if low is None else (c > F.lit(low).cast(kind)) & (c <= F.lit(high).cast(kind))


def as_text(column: str):
    """A watermark as text of a fixed width, without a detour over a float."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def high(spark: SparkSession, conn: Connection, feed: Feed) -> str | None:
    """The newest watermark of the source as text."""
    column, table = text.name(feed.mark, conn.dialect), text.name(feed.source, conn.dialect)
    if conn.dialect == "tsql":
        return _reader(spark, conn, 1).option("query", f"SELECT CONVERT(VARCHAR(27), MAX({column}), 121) AS top_mark FROM {table}").load().first()[0]
    found = _reader(spark, conn, 1).option("dbtable", f"(SELECT MAX({column}) AS top_mark FROM {table}) src").load()
    return found.select(as_text(found.columns[0])).first()[0]


def read(spark: SparkSession, conn: Connection, feed: Feed, window: Window, fetch_size: int = 10_000) -> DataFrame:
    where, table = predicate(feed, window, conn.dialect), text.name(feed.source, conn.dialect)
    reader = _reader(spark, conn, fetch_size).option("dbtable", f"(SELECT * FROM {table} WHERE {where}) src")
    if feed.policy.read_partitions > 1:
        key = text.name(feed.key[0], conn.dialect)
        low, top = _reader(spark, conn, 1).option("dbtable", f"(SELECT MIN({key}) AS a, MAX({key}) AS b FROM {table} WHERE {where}) src").load().first()
        if isinstance(low, int) and isinstance(top, int) and top > low:
            reader = reader.options(partitionColumn=feed.key[0], lowerBound=str(low), upperBound=str(top), numPartitions=str(feed.policy.read_partitions))
    return reader.load()
