"""Connected components of a link table by alternating large and small stars.

Every step is a join and an aggregation with a partial stage, so a node with
any number of links needs no task of its own; the links of a round are written
to the shared checkpoint folder before the next begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import common


def _smallest(links: DataFrame) -> DataFrame:
    """For each node its smallest neighbour or itself; links: both ways."""
    return links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v long); component: the smallest node reachable.

    Repeated links and links in either direction are fine; a link of a node
    with itself, or with null, is ignored.
    """
    common.shared_dir(links.sparkSession)
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct().checkpoint()
    state = None
    while True:
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        links = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct().checkpoint()
    ends = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
