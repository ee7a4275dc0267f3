"""Replication of change streams into current tables.

A micro-batch is split by table; each table's changes are typed, reduced to the
last of each key, and merged.  Deleted keys stay as tombstones, see
``operators.changes``, so a batch that arrives late or again does no harm.

A table is cut into ``buckets`` by a hash of its key.  A merge reads and
rewrites only the buckets that its changes fall into, and the join runs bucket
by bucket in parallel; give a large table enough buckets that one of them is a
comfortable task.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.audit import now
from sluice.functions import envelope
from sluice.operators import changes
from sluice.sources.lake import Table

_BUCKET = "_bucket"


@dataclass(frozen=True)
class Target:
    """A replicated table: its key, the types of the columns that are known, and how many buckets it is cut into."""

    keys: tuple[str, ...]
    types: Mapping[str, str] = field(default_factory=dict)
    buckets: int = 8


@dataclass
class BatchRecord:
    batch_id: int
    table: str
    rows: int = 0
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    skipped: int = 0
    first_offset: int | None = None
    last_offset: int | None = None
    replay: bool = False
    started_at: datetime = field(default_factory=now)
    duration_ms: int = 0

    @property
    def changed(self) -> int:
        return self.inserted + self.updated + self.deleted


def one_partition(batch: DataFrame, table: str) -> None:
    """Offsets order changes within one partition of a topic; more than one is an error."""
    others = [r[0] for r in batch.select("_partition").distinct().where("_partition <> 0").limit(10).collect()]
    if others:
        raise ValueError(f"table '{table}' has changes from partitions {sorted(others)}: offsets don't order them")


def merge(spark: SparkSession, path: str, target: Target, typed: DataFrame, note: dict[str, Any] | None = None) -> dict[str, int]:
    """Fold typed changes (with _op, _cdc_offset) into the table at ``path``; the counters of the merge."""
    bucket = F.pmod(F.xxhash64(*target.keys), F.lit(target.buckets)).cast("string")
    last = changes.folded(typed, target.keys).withColumn(_BUCKET, bucket)
    table = Table(spark, path)
    last = last.persist()
    try:
        base = table.snapshot()
        if base.schema is None:
            old, units = spark.createDataFrame([], last.schema), []
        else:
            # at most ``buckets`` values
            units = table.touched(base, [r[0] for r in last.select(_BUCKET).distinct().collect()])
            old = table.frame(base, units=units)
        if base.schema is None:
            base.partition_by = _BUCKET
        # Skipped changes may carry newer positions of deleted keys, so they are worth a version, too.
        counts = table.rewrite(base, units, changes.merged(old, last, target.keys), note=note, counts=changes.action_counts(), leave_out=["_action"])
    finally:
        last.unpersist()
    return {k: counts[k] for k in changes.COUNTERS}


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a replicated table that aren't deleted."""
    return changes.visible(Table(spark, path).read()).drop(_BUCKET)


def apply_batch(root: str, targets: Mapping[str, Target], batch: DataFrame, batch_id: int, *, ordered: bool = True, records: list[BatchRecord] | None = None) -> list[BatchRecord]:
    """Fold a decoded batch into the tables under ``root``.

    An error in one table leaves those before it merged; the replay finds that
    nothing in them is newer.  ``ordered``: insist on one partition.
    """
    spark, out = batch.sparkSession, [] if records is None else records
    batch = batch.persist()
    try:
        for name in sorted(r[0] for r in batch.select("_table").distinct().collect()):
            if name not in targets:
                raise KeyError(f"changes for unknown table '{name}'")
            own, record = batch.where(F.col("_table") == name), BatchRecord(batch_id, name)
            if ordered:
                one_partition(own, name)
            fields = envelope.fields_of(own)
            missing = [k for k in targets[name].keys if k not in fields]
            if missing:
                raise ValueError(f"changes for '{name}' lack key column(s) {missing}")
            typed = envelope.rows_of(own, targets[name].types, fields)
            if changes.null_key(typed, targets[name].keys):
                raise ValueError(f"a change for '{name}' has no value for a key column {list(targets[name].keys)}")
            seen = own.agg(F.count(F.lit(1)).alias("n"), F.min("_offset").alias("a"), F.max("_offset").alias("b")).first()
            counts = merge(spark, f"{root}/{name}", targets[name], typed, {"batch_id": batch_id})
            record.rows, record.first_offset, record.last_offset = seen["n"], seen["a"], seen["b"]
            for k in changes.COUNTERS:
                setattr(record, k, counts[k])
            record.replay = record.changed == 0 and record.skipped > 0
            record.duration_ms = round((now() - record.started_at).total_seconds() * 1000)
            out.append(record)
    finally:
        batch.unpersist()
    return out


def messages_from_files(spark: SparkSession, path: str, *, per_trigger: int | None = None, pattern: str = "*") -> DataFrame:
    """A stream of messages (topic, partition, offset, timestamp, value) that arrive as Parquet files."""
    reader = spark.readStream.schema("topic string, partition int, offset long, timestamp timestamp, value string").option("pathGlobFilter", pattern).option("maxFileAge", "36500d")
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def kafka_options(servers: str, topics: str, per_trigger: int | None = None) -> dict[str, str]:
    """All topics that match a pattern, from their beginning; a gap in the offsets is an error."""
    options = {"kafka.bootstrap.servers": servers, "subscribePattern": topics, "startingOffsets": "earliest", "failOnDataLoss": "true"}
    return options | ({"maxOffsetsPerTrigger": str(per_trigger)} if per_trigger else {})


def messages_from_kafka(spark: SparkSession, servers: str, topics: str, *, per_trigger: int | None = None, connector: str = "kafka") -> DataFrame:
    """A stream of messages as ``messages_from_files`` has them; needs Spark's Kafka connector on the class path."""
    found = spark.readStream.format(connector).options(**kafka_options(servers, topics, per_trigger)).load()
    return found.select("topic", "partition", "offset", "timestamp", F.col("value").cast("string").alias("value"))


def replicate(
    messages: DataFrame, root: str, targets: Mapping[str, Target], checkpoint: str, *, available_now: bool = False, ordered: bool = True, records: list[BatchRecord] | None = None
) -> StreamingQuery:
    """Start the stream; ``available_now``: end when what is there has been read.  Malformed messages go to ``_rejected``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        bad = envelope.rejected(batch)
        if not bad.isEmpty():
            Table(batch.sparkSession, f"{root}/_rejected").append(bad, transaction=("rejected", int(batch_id)), note={"batch_id": int(batch_id)})
        apply_batch(root, targets, envelope.decoded(batch), int(batch_id), ordered=ordered, records=records)

    writer = messages.writeStream.queryName("sluice.cdc").foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
