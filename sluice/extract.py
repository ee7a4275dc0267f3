"""Extraction: one window of a source table to the bronze layer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import metrics
from sluice.audit import Entry, Journal, as_rows
from sluice.layout import Settings
from sluice.plans import drift, state
from sluice.plans.spec import Feed, Pipeline
from sluice.sources import jdbc
from sluice.sources.drops import Drops
from sluice.sources.lake import Table


@dataclass(frozen=True)
class Source:
    """How a table's newest watermark and the rows of a window are got."""

    high: Callable[[Feed], str | None]
    read: Callable[[Feed, state.Window], DataFrame]


def from_jdbc(spark: SparkSession, conn: jdbc.Connection, fetch_size: int = 10_000) -> Source:
    return Source(lambda feed: jdbc.high(spark, conn, feed), lambda feed, w: jdbc.read(spark, conn, feed, w, fetch_size))


def from_frames(frame: Callable[[str], DataFrame]) -> Source:
    """A source whose tables are DataFrames; the window's filter reaches their scan."""

    def high(feed: Feed) -> str | None:
        return frame(feed.name).agg(F.max(feed.mark).alias("top")).select(jdbc.as_text("top")).first()[0]

    return Source(high, lambda feed, w: frame(feed.name).where(jdbc.in_window(feed.mark, w.low, w.high)))


def read_state(spark: SparkSession, path: str, pipeline: str, table: str) -> dict:
    stored = Table(spark, path)
    return stored.read().first().asDict() if stored.exists else state.blank(pipeline, table)


def write_state(spark: SparkSession, path: str, row: dict) -> None:
    Table(spark, path).overwrite(spark.createDataFrame([row], state.RECORD).coalesce(1))


def journal(spark: SparkSession, settings: Settings, run_id: str, pipeline: Pipeline) -> Journal:
    """The journal of a run, whose entries are pushed as metrics where a gateway is set."""

    def heard(entry: Entry) -> None:
        feed = pipeline.feeds.get(entry["table_name"])
        if settings.gateway and feed:
            gauges = metrics.of_stages(as_rows(spark, [entry]), {r.name: r.severity for r in feed.rules})
            metrics.push(metrics.text(gauges), settings.gateway, pipeline=pipeline.name, table=feed.name, stage=entry["stage"])

    return Journal(spark, settings.lake.audit, run_id, pipeline.name, heard)


def stamped(rows: DataFrame, run_id: str, seq: int) -> DataFrame:
    """Rows with the technical columns of bronze."""
    return rows.withColumns({"_run_id": F.lit(run_id), "_extract_seq": F.lit(seq).cast("long"), "_ingested_at": F.current_timestamp()}).withColumn("_ingest_date", F.to_date("_ingested_at"))


def run_extract(
    spark: SparkSession, pipeline: Pipeline, feed: Feed, run_id: str, settings: Settings, source: Source | None = None, crash: Callable[[str], None] = lambda point: None
) -> Entry:
    """Take the next window, or the one that a failed run has noted.

    The schema is judged before anything is noted or written.  ``crash`` is
    called at points where tests end the run.
    """
    control = settings.lake.control(pipeline.name, feed.name)
    bronze = Drops(spark, settings.lake.bronze(pipeline.name, feed.name))
    with journal(spark, settings, run_id, pipeline).stage(feed.name, "extract") as entry:
        source = source or from_jdbc(spark, jdbc.Connection.from_env(pipeline.connection), pipeline.fetch_size)
        known = read_state(spark, control, pipeline.name, feed.name)
        window = state.next_window(known, lambda: source.high(feed))
        if window is None:
            done = known["committed_watermark"]
            entry.idle("the source has nothing newer", watermark_from=done, watermark_to=done, table_version=max(bronze.numbers(), default=None))
            return entry
        entry.note(batch_id=window.seq, recovered=window.recovered, watermark_from=window.low, watermark_to=window.high)
        rows = source.read(feed, window)
        incoming = drift.types(rows)
        before = state.known_types(known) or drift.business(bronze.types() or {}) or None
        found = drift.accept(feed.name, drift.between(before, incoming), feed.policy.schema_evolution)
        entry.note(schema_changes=[str(d) for d in found])
        if not window.recovered:
            known = state.noted(known, window)
            write_state(spark, control, known)
        written = bronze.append(stamped(rows, run_id, window.seq), window.seq)
        crash("bronze committed")
        if written is None:
            entry.note(f"bronze has window {window.seq} already, nothing written")
        entry.note(table_version=window.seq, rows_read=written or 0, rows_written=written or 0)
        write_state(spark, control, state.done(known, incoming))
    return entry
