"""Validation: new bronze deliveries, judged, to quarantine and silver.

Each micro-batch goes through: rules, quarantine, gate, silver, and only then
the stream's own commit.  A batch that fails anywhere is replayed with its id;
the quarantine knows the id and the silver merge takes newer rows only, so what
was done the first time stays as it is.  The time that ``not_future`` compares
with is kept beside the checkpoint by batch id, so a replay judges alike.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.audit import FAILED, Entry, now
from sluice.extract import journal
from sluice.layout import Settings, application
from sluice.operators import quality
from sluice.operators.changes import action_counts, upserted
from sluice.operators.latest import latest
from sluice.plans import drift
from sluice.plans.spec import Feed, Pipeline
from sluice.sources.drops import Drops
from sluice.sources.files import Files
from sluice.sources.lake import Table
from sluice.streaming import checkpoints

MOST_PARTITIONS = 1000


def judged_as_of(spark: SparkSession, checkpoint: str, batch_id: int, as_of: datetime | None) -> datetime:
    """The time that a batch is judged by: that of its first try."""
    path = f"{checkpoint}/as_of/{batch_id}"
    files = Files(spark)
    files.publish(path, (as_of or now()).astimezone(UTC).isoformat())
    return datetime.fromisoformat(files.read(path))


def silver_keys(spark: SparkSession, settings: Settings, pipeline: str) -> Callable[[str, str], DataFrame | None]:
    def keys(table: str, column: str) -> DataFrame | None:
        silver = Table(spark, settings.lake.silver(pipeline, table))
        return silver.read().select(column) if silver.exists else None

    return keys


def merge_silver(spark: SparkSession, rows: DataFrame, feed: Feed, path: str, entry: Entry) -> None:
    """Newer rows replace older ones of their key; only the partitions that occur in ``rows`` are read and rewritten."""
    table, note = Table(spark, path), {"run_id": entry["run_id"], "batch_id": entry["batch_id"]}
    values = table.values_in(rows, feed.partition, MOST_PARTITIONS) if feed.partition else None
    entry.note(partitions_touched=sorted(map(str, values or ())))
    base = table.snapshot()
    if base.schema is None:
        table.append(rows, partition_by=feed.partition, note=note)
        entry.note(rows_written=table.last_metrics()["rows"], table_version=table.version)
        return
    entry.note(schema_changes=[str(d) for d in drift.between(table.schema_types(), drift.types(rows)) if d.kind == "added"])
    units = table.touched(base, values)
    merged = upserted(table.frame(base, units=units), rows, feed.key, feed.mark)
    done = table.rewrite(base, units, merged, note=note, counts=action_counts(), leave_out=["_action"], worth=lambda m: m["inserted"] + m["updated"] > 0)
    if changed := done["inserted"] + done["updated"]:
        entry.note(f"{done['inserted']} new and {done['updated']} newer rows merged, {len(units)} unit(s) rewritten", rows_written=changed, files_rewritten=len(units))
    entry.note(table_version=table.version)


def quarantined(rows: DataFrame, business: list[str], entry: Entry) -> DataFrame:
    """The invalid rows as the quarantine stores them."""
    stamps = {"_validate_run_id": F.lit(entry["run_id"]), "_batch_id": F.lit(entry["batch_id"]).cast("long"), "_quarantined_at": F.current_timestamp()}
    return rows.where(quality.has_errors()).withColumns(stamps).select(*business, *drift.QUARANTINE)


def process(
    spark: SparkSession,
    batch: DataFrame,
    entry: Entry,
    feed: Feed,
    settings: Settings,
    as_of: datetime,
    threshold: float | None = None,
    crash: Callable[[str], None] = lambda point: None,
) -> None:
    """Judge a batch and store what became of its rows; what happened is noted in ``entry``."""
    pipeline, lake = entry["pipeline"], settings.lake
    quarantine, silver = Table(spark, lake.quarantine(pipeline, feed.name)), lake.silver(pipeline, feed.name)
    checked = quality.judged(batch, feed.rules, as_of, silver_keys(spark, settings, pipeline)).persist()
    try:
        found = quality.totals(checked, feed.rules, feed.policy, threshold).first()
        entry.note(rows_read=found["rows"], rows_quarantined=found["quarantined"], rows_warned=found["warned"], rule_failures={r: n for r, n in found["failures"].items() if n})
        if not found["rows"]:
            entry.note("the batch is empty")
            return
        rows = quality.without_flags(checked, feed.rules)
        business = [c for c in batch.columns if c not in drift.TECHNICAL]
        if found["quarantined"]:
            once = (application(pipeline, feed.name, "quarantine"), entry["batch_id"])
            if not quarantine.append(quarantined(rows, business, entry), transaction=once, note={"run_id": entry["run_id"], "batch_id": entry["batch_id"]}):
                entry.note(f"quarantine has batch {entry['batch_id']} already, nothing added")
        entry.note(quarantine_version=quarantine.version)
        if found["tripped"]:
            raise quality.refusal(feed.name, found["rows"], found["quarantined"], feed.policy.quarantine_threshold if threshold is None else threshold)
        if found["rows"] > found["quarantined"]:
            valid = latest(rows.where(~quality.has_errors()), feed.key, [feed.mark, "_extract_seq"]).select(*business, *drift.SILVER).persist()
            try:
                merge_silver(spark, valid, feed, silver, entry)
            finally:
                valid.unpersist()
        else:
            entry.note(table_version=Table(spark, silver).version)
        crash("silver merged")
    finally:
        checked.unpersist()


def run_validate(
    spark: SparkSession,
    pipeline: Pipeline,
    feed: Feed,
    run_id: str,
    settings: Settings,
    as_of: datetime | None = None,
    threshold: float | None = None,
    crash: Callable[[str], None] = lambda point: None,
) -> list[Entry]:
    """All deliveries that have come since the last run; an entry for each micro-batch."""
    lake, entries = settings.lake, []
    bronze, checkpoint = Drops(spark, lake.bronze(pipeline.name, feed.name)), lake.checkpoint(pipeline.name, feed.name, "validate")
    log = journal(spark, settings, run_id, pipeline)
    if not bronze.exists:
        with log.stage(feed.name, "validate") as entry:
            entry.idle("nothing was extracted yet")
        return [entry]
    replayed = checkpoints.pending(spark, checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession  # the stream's session, not the one that started it
        with journal(own, settings, run_id, pipeline).stage(feed.name, "validate", passes=True, batch_id=int(batch_id), recovered=batch_id == replayed) as entry:
            entries.append(entry)
            frame = batch.persist()
            try:
                process(own, frame, entry, feed, settings, judged_as_of(own, checkpoint, int(batch_id), as_of), threshold, crash)
            finally:
                frame.unpersist()

    query = bronze.stream().writeStream.queryName(f"sluice.{pipeline.name}.{feed.name}.validate.{run_id}").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if not any(e["status"] == FAILED for e in entries):  # the stream itself
            with log.stage(feed.name, "validate") as entry:
                entries.append(entry)
                raise
    if not entries:
        with log.stage(feed.name, "validate") as entry:
            entries.append(entry.idle("no new deliveries", table_version=Table(spark, lake.silver(pipeline.name, feed.name)).version))
    return entries
