"""Tables about runs, from the audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.operators.quality import REFUSED

HEALTHY = ("SUCCEEDED", "NO_DATA")
OUTCOMES = ("succeeded", "no_data", "failed", "not_run")


def last_status(audit: DataFrame) -> DataFrame:
    """table_name, stage, status: of the last run of each."""
    return audit.groupBy("table_name", "stage").agg(F.max_by("status", F.struct("finished_at", F.coalesce("batch_id", F.lit(-1)))).alias("status"))


def outcomes(audit: DataFrame, tables: DataFrame) -> DataFrame:
    """table_name, outcome, for every table of ``tables``: failed before not_run before no_data before succeeded."""
    last = last_status(audit).groupBy("table_name").agg(*(F.max(F.when(F.col("stage") == s, F.col("status"))).alias(s) for s in ("extract", "validate")))
    of = tables.select("table_name").join(last, "table_name", "left")
    any_is = lambda test: F.coalesce(test(F.col("extract")), F.lit(False)) | F.coalesce(test(F.col("validate")), F.lit(False))
    outcome = (
        F.when(any_is(lambda s: ~s.isin(*HEALTHY)), "failed")
        .when(F.col("extract").isNull() | F.col("validate").isNull(), "not_run")
        .when((F.col("extract") == "NO_DATA") & (F.col("validate") == "NO_DATA"), "no_data")
        .otherwise("succeeded")
    )
    return of.select("table_name", outcome.alias("outcome"))


def histogram(found: DataFrame, column: str = "outcome") -> DataFrame:
    return found.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def rule_totals(audit: DataFrame) -> DataFrame:
    """rule, failures over all runs that judged a batch: those that succeeded, or that the gate stopped."""
    judged = (F.col("stage") == "validate") & ((F.col("status") == "SUCCEEDED") | F.col("error").startswith(REFUSED))
    counts = audit.where(judged).select(F.explode(F.from_json("rule_failures", "map<string,bigint>")).alias("rule", "failures"))
    return counts.groupBy("rule").agg(F.sum("failures").alias("failures"))


def by_run(audit: DataFrame, column: str, tables: list[str]) -> DataFrame:
    """run_id and a column for each table with the sum of ``column``."""
    return audit.groupBy("run_id").pivot("table_name", tables).agg(F.sum(column))


def alerts(audit: DataFrame, ratio: float = 0.05) -> DataFrame:
    """run_id, table_name, severity, alert: failed stages, large quarantines, changed schemas."""
    share = F.col("rows_quarantined") / F.nullif(F.col("rows_read"), F.lit(0))
    kinds: list[tuple[str, str, Column]] = [
        ("critical", "stage failed", F.col("status") == "FAILED"),
        ("warning", "quarantine ratio", F.coalesce(share > ratio, F.lit(False))),
        ("info", "schema changed", F.coalesce(F.col("schema_changes"), F.lit("[]")) != "[]"),
    ]
    raised = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(s).alias("severity"), F.lit(a).alias("alert"))) for s, a, test in kinds)))
    stages = audit.select("run_id", "table_name", F.explode(raised).alias("a")).select("run_id", "table_name", "a.severity", "a.alert")
    failed = audit.groupBy("run_id").agg(F.max((F.col("status") == "FAILED").cast("int")).alias("f")).where("f = 1")
    return stages.unionByName(failed.select("run_id", F.lit(None).cast("string").alias("table_name"), F.lit("critical").alias("severity"), F.lit("pipeline failed").alias("alert")))


def kpis(**tables: DataFrame) -> DataFrame:
    """name, rows of some tables."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def newest_first(audit: DataFrame) -> DataFrame:
    return audit.orderBy(F.desc("finished_at"))
