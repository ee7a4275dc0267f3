"""Running a pipeline's tasks in one process, and the report at its end."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sluice import audit, metrics
from sluice.audit import FAILED, SUCCEEDED, Entry
from sluice.extract import Source, journal, run_extract
from sluice.layout import Settings
from sluice.operators import reports
from sluice.plans import graph
from sluice.plans.spec import Pipeline
from sluice.sources.files import Files
from sluice.streaming.validate import run_validate

UPSTREAM_FAILED = "UPSTREAM_FAILED"


class UnhealthyRun(RuntimeError):
    verbatim = True


@dataclass
class Done:
    """What became of a task; one that had to wait for a failed one has no entries."""

    state: str
    entries: list[Entry] = field(default_factory=list)

    @property
    def error(self) -> str | None:
        return next((e["error"] for e in self.entries if e["error"]), None)


def outcome(results: dict[str, Done]) -> str:
    return SUCCEEDED if all(d.state == SUCCEEDED for d in results.values()) else FAILED


def run_report(spark: SparkSession, pipeline: Pipeline, run_id: str, settings: Settings) -> Entry:
    """How each table fared; the report fails if one failed or was not run."""
    tables = spark.createDataFrame([(t,) for t in pipeline.feeds], "table_name string")
    runs = audit.records(spark, settings.lake.audit, run_id).where((F.col("pipeline") == pipeline.name) & (F.col("stage") != graph.REPORT))
    with journal(spark, settings, run_id, pipeline).stage("*", graph.REPORT) as entry:
        outcomes = reports.outcomes(runs, tables).withColumn("pipeline", F.lit(pipeline.name))
        found = {r["table_name"]: r["outcome"] for r in outcomes.collect()}  # a row for each table
        entry.note("; ".join(f"{t} {found[t]}" for t in pipeline.feeds))
        if bad := [t for t in pipeline.feeds if found[t] in ("failed", "not_run")]:
            raise UnhealthyRun(f"not healthy: {', '.join(f'{t} ({found[t]})' for t in bad)}")
    if settings.gateway:
        counts = outcomes.groupBy("pipeline", "outcome").agg(F.count(F.lit(1)).alias("n"))
        metrics.push(metrics.text(metrics.of_pipelines(audit.as_rows(spark, [entry]), counts)), settings.gateway, pipeline=pipeline.name)
    return entry


def run_pipeline(
    spark: SparkSession,
    pipeline: Pipeline,
    run_id: str,
    settings: Settings,
    source: Source | None = None,
    *,
    as_of: datetime | None = None,
    threshold: float | None = None,
    crash: Callable[[str, str], None] = lambda task, point: None,
) -> dict[str, Done]:
    """What became of every task, in order; one that waits for a task that did not succeed is left out, the report never is."""
    waits, results = graph.plan(pipeline), {}

    def entries(name: str) -> Iterator[Entry]:
        table, stage = graph.parts(name)
        here = lambda point: crash(name, point)
        if stage == graph.REPORT:
            yield run_report(spark, pipeline, run_id, settings)
        elif stage == graph.EXTRACT:
            yield run_extract(spark, pipeline, pipeline.feeds[table], run_id, settings, source, here)
        else:
            yield from run_validate(spark, pipeline, pipeline.feeds[table], run_id, settings, as_of, threshold, here)

    for name in graph.ordered(waits):
        if name != graph.FINAL and any(results[other].state != SUCCEEDED for other in waits[name]):
            results[name] = Done(UPSTREAM_FAILED)
        else:
            own = [*entries(name)]
            results[name] = Done(SUCCEEDED if all(e.healthy for e in own) else FAILED, own)
    return results


def reset(spark: SparkSession, pipeline: Pipeline, table: str, settings: Settings) -> list[str]:
    """Forget a table's validation: silver, quarantine and the stream's checkpoint; bronze and its watermark stay."""
    files, lake = Files(spark), settings.lake
    parts = [lake.silver(pipeline.name, table), lake.quarantine(pipeline.name, table), lake.checkpoint(pipeline.name, table, graph.VALIDATE)]
    return [p for p in parts if files.exists(p) and files.delete(p)]
