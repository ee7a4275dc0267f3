"""The newest row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the first by ``order``, each column descending.

    Where these leave a tie, the row of the greatest content wins, so that the
    choice doesn't depend on how rows are spread.  Spark limits the window's
    groups before the shuffle, so a key with many rows sends one from each task.
    """
    place = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order), F.xxhash64(*_hashable(df)).desc())
    return df.withColumn("__place", F.row_number().over(place)).where("__place = 1").drop("__place")


def _hashable(df: DataFrame) -> list:
    """All columns; a map, which has no hash, by its entries."""
    return [F.sort_array(F.map_entries(f.name)) if f.dataType.typeName() == "map" else F.col(f"`{f.name}`") for f in df.schema.fields]
