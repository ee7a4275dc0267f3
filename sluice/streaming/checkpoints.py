"""What a streaming checkpoint says: batches that were begun, and those that were committed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from sluice.sources.files import Files


def _ids(spark: SparkSession, folder: str) -> set[int]:
    return {int(n) for n in Files(spark).names(folder) if n.isdigit()}


def begun(spark: SparkSession, checkpoint: str) -> set[int]:
    return _ids(spark, f"{checkpoint}/offsets")


def committed(spark: SparkSession, checkpoint: str) -> set[int]:
    return _ids(spark, f"{checkpoint}/commits")


def pending(spark: SparkSession, checkpoint: str) -> int | None:
    """The batch that was begun last, if it wasn't committed: the next run starts with it again."""
    last = max(begun(spark, checkpoint), default=None)
    return last if last is not None and last not in committed(spark, checkpoint) else None


def last_end(spark: SparkSession, checkpoint: str) -> int | None:
    """Where the last committed batch ended in its source's log; None before the first."""
    done = committed(spark, checkpoint)
    if not done:
        return None
    told = Files(spark).read(f"{checkpoint}/offsets/{max(done)}").splitlines()[-1]
    return json.loads(told)["logOffset"]


def batches(spark: SparkSession, checkpoint: str) -> DataFrame:
    """batch_id, committed."""
    done = committed(spark, checkpoint)
    return spark.createDataFrame([(b, b in done) for b in sorted(begun(spark, checkpoint))], "batch_id long, committed boolean")
