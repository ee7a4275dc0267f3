"""Folding changes into a table: merging by key, with deletes that stay known.

A change counts only if it is newer than what the table knows of its key.  A
deleted key is kept as a tombstone with the position of its delete, so an older
change that comes later finds it and is dropped: the order in which changes
arrive doesn't matter, nor that some arrive twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.latest import latest

DELETED = "_deleted"
COUNTERS = ("inserted", "updated", "deleted", "skipped")


def null_key(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether a row lacks a part of its key."""
    return not df.where(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).isEmpty()


def folded(changes: DataFrame, keys: Sequence[str], position: str = "_cdc_offset") -> DataFrame:
    """The last change of each key, with ``_deleted``."""
    return latest(changes, keys, [position]).withColumn(DELETED, F.col("_op") == "d")


def aligned(df: DataFrame, columns: Sequence[str], like: DataFrame) -> DataFrame:
    """``df`` with the given columns in their order; one that it lacks is null of the type it has in ``like``."""
    return df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in columns))


def merged(target: DataFrame, changes: DataFrame, keys: Sequence[str], position: str = "_cdc_offset") -> DataFrame:
    """The table after the changes, tombstones included, and the column ``_action``.

    target: with tombstones; changes: one row for each key.  _action says what
    became of a change (one of ``COUNTERS``), or is null for other rows.
    """
    columns = list(dict.fromkeys([*target.columns, *changes.columns]))
    old = aligned(target, columns, changes).select(F.struct("*").alias("t"), *(F.col(k).alias(f"__t_{k}") for k in keys))
    new = aligned(changes, columns, target).select(F.struct("*").alias("s"), *(F.col(k).alias(f"__s_{k}") for k in keys))
    both = old.join(new, reduce(lambda a, b: a & b, [F.col(f"__t_{k}") == F.col(f"__s_{k}") for k in keys]), "full_outer")
    arrives, stands = F.col("s").isNotNull(), F.col("t").isNotNull()
    newer = arrives & (~stands | (F.col("s")[position] > F.coalesce(F.col("t")[position], F.lit(-1))))
    alive = stands & ~F.coalesce(F.col("t")[DELETED], F.lit(False))
    removes = F.coalesce(F.col("s")[DELETED], F.lit(False))
    action = (
        F.when(~arrives, F.lit(None).cast("string"))
        .when(~newer | (removes & ~alive), "skipped")
        .when(removes, "deleted")
        .when(alive, "updated")
        .otherwise("inserted")
    )
    row = F.when(newer, F.col("s")).otherwise(F.col("t"))
    return both.select(row.alias("row"), action.alias("_action")).select("row.*", "_action")


def visible(table: DataFrame) -> DataFrame:
    """The rows that aren't deleted."""
    return table.where(~F.coalesce(F.col(DELETED), F.lit(False))).drop(DELETED)


def action_counts() -> dict[str, Column]:
    """The counters of a merge as aggregates of ``_action``."""
    return {c: F.count(F.when(F.col("_action") == c, 1)) for c in COUNTERS}


def counters(actions: DataFrame) -> DataFrame:
    """inserted, updated, deleted, skipped, changed of a merge."""
    return actions.agg(*(c.alias(k) for k, c in action_counts().items())).withColumn("changed", F.col("inserted") + F.col("updated") + F.col("deleted"))


def upserted(target: DataFrame, rows: DataFrame, keys: Sequence[str], watermark: str) -> DataFrame:
    """The table after newer rows have replaced older ones and new ones have come; with ``_action``.

    A row of the same watermark as the table's, or an older one, changes nothing.
    """
    columns = list(dict.fromkeys([*target.columns, *rows.columns]))
    old = aligned(target, columns, rows).select(F.struct("*").alias("t"), *(F.col(k).alias(f"__t_{k}") for k in keys))
    new = aligned(rows, columns, target).select(F.struct("*").alias("s"), *(F.col(k).alias(f"__s_{k}") for k in keys))
    both = old.join(new, reduce(lambda a, b: a & b, [F.col(f"__t_{k}") == F.col(f"__s_{k}") for k in keys]), "full_outer")
    replaces = F.col("s")[watermark] > F.col("t")[watermark]
    fresh = F.col("t").isNull()
    action = F.when(F.col("s").isNull(), F.lit(None).cast("string")).when(fresh, "inserted").when(replaces, "updated").otherwise("skipped")
    row = F.when(fresh | F.coalesce(replaces, F.lit(False)), F.col("s")).otherwise(F.col("t"))
    return both.select(row.alias("row"), action.alias("_action")).select("row.*", "_action")


def differences(left: DataFrame, right: DataFrame) -> dict[str, int]:
    """Rows, value for value, that only one side has; two equal tables have none."""
    columns = sorted(set(left.columns) & set(right.columns))
    a, b = left.select(*columns), right.select(*columns)
    return {"only_left": a.exceptAll(b).count(), "only_right": b.exceptAll(a).count(), "unshared_columns": len(set(left.columns) ^ set(right.columns))}


def missing_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of ``left`` that ``right`` doesn't have."""
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_anti")


def waiting(events: DataFrame, processed: DataFrame, most: int, key: str = "event_id", order: str = "offset") -> DataFrame:
    """The oldest ``most`` events that aren't processed."""
    if most < 1:
        raise ValueError("a batch needs one event or more")
    return events.join(processed.select(key), key, "left_anti").orderBy(order, key).limit(most)
