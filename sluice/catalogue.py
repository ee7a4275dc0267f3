"""One query for each operator of the engine, over the test tables, and the same in SQL.

The tables hold no faults, so ``dirty_orders`` and the like make some, by the
remainders of keys, as a shop would have them.  Outputs are plain numbers and
texts, so that two engines' results can be compared value by value.
"""

from __future__ import annotations

import re
import shutil
import zipfile
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import metrics, scratch
from sluice.functions import envelope
from sluice.functions.rules import ForeignKey, Rule
from sluice.operators import changes, quality, reports
from sluice.operators.latest import latest
from sluice.plans import drift, graph, spec, state
from sluice.sources import jdbc
from sluice.sources.drops import Drops
from sluice.sources.lake import Table
from sluice.streaming import cdc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = datetime(2002, 1, 1, tzinfo=UTC)
PIPELINE = spec.parse(
    {
        "pipeline": "shop",
        "source": {"type": "files", "connection": "shop"},
        "tables": [
            {
                "name": "customers",
                "source_table": "sales.customers",
                "primary_key": ["customer_id"],
                "watermark_column": "modified_at",
                "rules": [
                    {"name": "has_email", "type": "not_null", "column": "email"},
                    {"name": "email_has_host", "type": "regex", "column": "email", "pattern": "@[a-z]+[.]"},
                    {"name": "country_code_of_two", "type": "length", "column": "country_code", "min": 2, "max": 2},
                    {"name": "signed_up_by_now", "type": "not_future", "column": "signup_date", "severity": "warn"},
                ],
            },
            {
                "name": "products",
                "source_table": "sales.products",
                "primary_key": ["product_id"],
                "watermark_column": "modified_at",
                "rules": [
                    {"name": "sku_ends_in_digits", "type": "regex", "column": "sku", "pattern": "-[0-9]{5,}$"},
                    {"name": "price_in_range", "type": "range", "column": "unit_price", "min": 0.05, "max": 50000},
                    {"name": "known_category", "type": "allowed_values", "column": "category", "values": ["ECONOMY", "SMALL", "MEDIUM", "LARGE", "STANDARD", "PROMO"]},
                ],
            },
            {
                "name": "orders",
                "source_table": "sales.orders",
                "primary_key": ["order_id"],
                "watermark_column": "modified_at",
                "partition_by": "order_date",
                "rules": [
                    {"name": "has_customer", "type": "not_null", "column": "customer_id"},
                    {"name": "known_customer", "type": "foreign_key", "column": "customer_id", "references": {"table": "customers", "column": "customer_id"}},
                    {"name": "some_quantity", "type": "range", "column": "quantity", "min": 1, "max": 500},
                    {"name": "amount_from_zero", "type": "range", "column": "amount", "min": 0},
                    {"name": "known_status", "type": "allowed_values", "column": "status", "values": ["PLACED", "PAID", "DELIVERED"]},
                    {"name": "ordered_by_now", "type": "not_future", "column": "order_date"},
                    {"name": "delivered_after_order", "type": "compare", "column": "delivered_date", "operator": ">=", "other_column": "order_date", "severity": "warn"},
                ],
            },
        ],
    }
)
#: What each rule rejects, written by hand: the twins don't go through the library's own rendering.
REJECTS = {
    "pk_customer_id_not_null": "customer_id IS NULL",
    "has_email": "email IS NULL",
    "email_has_host": "email IS NOT NULL AND NOT regexp_matches(email, '@[a-z]+[.]')",
    "country_code_of_two": "length(country_code) <> 2",
    "signed_up_by_now": "signup_date > DATE '2002-01-01'",
    "pk_product_id_not_null": "product_id IS NULL",
    "sku_ends_in_digits": "NOT regexp_matches(sku, '-[0-9]{5,}$')",
    "price_in_range": "unit_price < 0.05 OR unit_price > 50000",
    "known_category": "category NOT IN ('ECONOMY', 'SMALL', 'MEDIUM', 'LARGE', 'STANDARD', 'PROMO')",
    "pk_order_id_not_null": "order_id IS NULL",
    "partition_order_date_not_null": "order_date IS NULL",
    "has_customer": "customer_id IS NULL",
    "known_customer": "customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer AS k WHERE k.c_custkey = customer_id)",
    "some_quantity": "quantity < 1 OR quantity > 500",
    "amount_from_zero": "amount < 0",
    "known_status": "status NOT IN ('PLACED', 'PAID', 'DELIVERED')",
    "ordered_by_now": "order_date > DATE '2002-01-01'",
    "delivered_after_order": "delivered_date < order_date",
}
_WARNINGS = ("signed_up_by_now", "delivered_after_order")
_ORDER_RULES = ("pk_order_id_not_null", "partition_order_date_not_null", "has_customer", "known_customer", "some_quantity", "amount_from_zero", "known_status", "ordered_by_now", "delivered_after_order")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- inputs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(n: int, key: str) -> Column:
    return F.col(key) % n == 0


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "o_orderkey"
    day = F.col("o_orderdate").cast("date")
    status = F.when(_every(107, k), "LOST").when(F.col("o_orderstatus") == "F", "DELIVERED").when(F.col("o_orderstatus") == "P", "PAID").otherwise("PLACED")
    ordered = F.when(_every(109, k), F.lit(None)).when(_every(113, k), F.lit("2002-06-15").cast("date")).otherwise(day)
    return _table(spark, sf_dir, "orders").select(
        F.col(k).alias("order_id"),
        F.when(_every(97, k), F.lit(None)).when(_every(101, k), 900_000 + F.col(k)).otherwise(F.col("o_custkey")).alias("customer_id"),
        F.when(_every(127, k), F.lit(0)).otherwise(1 + F.col(k) % 5).cast("int").alias("quantity"),
        F.when(_every(103, k), F.lit("-49.99").cast("decimal(12,2)")).otherwise(F.col("o_totalprice").cast("decimal(12,2)")).alias("amount"),
        status.alias("status"),
        ordered.alias("order_date"),
        F.when(_every(131, k), F.date_sub(day, 3)).when(F.col("o_orderstatus") == "F", F.date_add(day, 5)).alias("delivered_date"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col(k))).alias("modified_at"),
    )


def dirty_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "c_custkey"
    return _table(spark, sf_dir, "customer").select(
        F.col(k).alias("customer_id"),
        F.when(_every(31, k), F.lit(None)).when(_every(37, k), F.lit("no-at-sign.example.com")).otherwise(F.concat(F.lit("c"), F.col(k), F.lit("@example.com"))).alias("email"),
        F.when(_every(41, k), "IND").otherwise("IN").alias("country_code"),
        F.when(_every(43, k), F.lit("2002-03-01")).otherwise(F.lit("2001-03-01")).cast("date").alias("signup_date"),
        (F.lit("2001-06-01").cast("timestamp") + F.make_dt_interval(secs=F.col(k))).alias("modified_at"),
    )


def dirty_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "p_partkey"
    return _table(spark, sf_dir, "part").select(
        F.col(k).alias("product_id"),
        F.when(_every(29, k), F.lit("SKU12")).otherwise(F.concat(F.lit("SKU-"), (10_000 + F.col(k)).cast("string"))).alias("sku"),
        F.when(_every(23, k), F.lit("Toys")).otherwise(F.col("p_type")).alias("category"),
        F.when(_every(19, k), F.lit("0.00").cast("decimal(10,2)")).otherwise(F.col("p_retailprice").cast("decimal(10,2)")).alias("unit_price"),
        (F.lit("2001-06-01").cast("timestamp") + F.make_dt_interval(secs=F.col(k))).alias("modified_at"),
    )


ORDERS = """dirty_orders AS (
  SELECT o_orderkey AS order_id,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN 900000 + o_orderkey ELSE o_custkey END AS customer_id,
    CASE WHEN o_orderkey % 127 = 0 THEN 0 ELSE 1 + o_orderkey % 5 END AS quantity,
    CASE WHEN o_orderkey % 103 = 0 THEN -49.99 ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS amount,
    CASE WHEN o_orderkey % 107 = 0 THEN 'LOST' WHEN o_orderstatus = 'F' THEN 'DELIVERED' WHEN o_orderstatus = 'P' THEN 'PAID' ELSE 'PLACED' END AS status,
    CASE WHEN o_orderkey % 109 = 0 THEN NULL WHEN o_orderkey % 113 = 0 THEN DATE '2002-06-15' ELSE CAST(o_orderdate AS DATE) END AS order_date,
    CASE WHEN o_orderkey % 131 = 0 THEN CAST(o_orderdate AS DATE) - 3 WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 5 END AS delivered_date,
    o_orderdate + to_seconds(o_orderkey) AS modified_at
  FROM orders)"""
CUSTOMERS = """dirty_customers AS (
  SELECT c_custkey AS customer_id,
    CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN 'no-at-sign.example.com' ELSE 'c' || c_custkey || '@example.com' END AS email,
    CASE WHEN c_custkey % 41 = 0 THEN 'IND' ELSE 'IN' END AS country_code,
    CASE WHEN c_custkey % 43 = 0 THEN DATE '2002-03-01' ELSE DATE '2001-03-01' END AS signup_date
  FROM customer)"""
PRODUCTS = """dirty_products AS (
  SELECT p_partkey AS product_id,
    CASE WHEN p_partkey % 29 = 0 THEN 'SKU12' ELSE 'SKU-' || (10000 + p_partkey) END AS sku,
    CASE WHEN p_partkey % 23 = 0 THEN 'Toys' ELSE p_type END AS category,
    CASE WHEN p_partkey % 19 = 0 THEN 0.00 ELSE CAST(p_retailprice AS DECIMAL(10,2)) END AS unit_price
  FROM part)"""
_INPUTS = {"orders": dirty_orders, "customers": dirty_customers, "products": dirty_products}
_CTES = {"orders": ORDERS, "customers": CUSTOMERS, "products": PRODUCTS}


def _keys(spark: SparkSession, sf_dir: str) -> Callable[[str, str], DataFrame | None]:
    return lambda table, column: _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(column))


def _judged(spark: SparkSession, sf_dir: str, table: str = "orders") -> DataFrame:
    return quality.judged(_INPUTS[table](spark, sf_dir), PIPELINE.feeds[table].rules, AS_OF, _keys(spark, sf_dir))


def _fails_sql(rule: str) -> str:
    return f"coalesce({REJECTS[rule]}, false)"


def _names_sql(severity: str) -> str:
    own = [r for r in _ORDER_RULES if (r in _WARNINGS) == (severity == "warn")]
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {_fails_sql(r)} THEN '{r}' END" for r in own) + ")"


JUDGED = f"""WITH {ORDERS}, judged AS (
  SELECT *, {_names_sql("error")} AS errors, {_names_sql("warn")} AS warnings FROM dirty_orders)"""


# ---------------------------------------------------------------- rules


def _rule_query(table: str, rule: Rule) -> None:
    key = PIPELINE.feeds[table].key[0]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _INPUTS[table](spark, sf_dir)
        schema = df.schema
        if rule.referenced:
            df = quality.with_found(df, rule, _keys(spark, sf_dir)(*rule.referenced))
        return df.where(rule.fails(AS_OF, schema)).select(F.col(key).cast("long").alias("key"), F.col(rule.column).cast("string").alias("value"))

    value = f"CAST({rule.column} AS VARCHAR)"
    query(f"dq_{rule.kind}_{rule.name}", f"WITH {_CTES[table]} SELECT {key} AS key, {value} AS value FROM dirty_{table} WHERE {_fails_sql(rule.name)}")(run)


for _feed in PIPELINE.feeds.values():
    for _rule in _feed.rules:
        if not _rule.implicit:
            _rule_query(_feed.name, _rule)


@query("dq_errors_warnings", f"{JUDGED} SELECT order_id, errors, warnings FROM judged")
def dq_errors_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the failed rules of every order, implicit ones first."""
    return _judged(spark, sf_dir).select("order_id", F.array_join("_dq_errors", ",").alias("errors"), F.array_join("_dq_warnings", ",").alias("warnings"))


@query(
    "dq_rule_counts",
    f"WITH {ORDERS} "
    + " UNION ALL ".join(f"SELECT '{r}' AS rule, '{'warn' if r in _WARNINGS else 'error'}' AS severity, count(*) FILTER ({_fails_sql(r)}) AS failures FROM dirty_orders" for r in _ORDER_RULES),
)
def dq_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rule_counts(_judged(spark, sf_dir), PIPELINE.feeds["orders"].rules)


@query(
    "dq_batch_totals",
    f"{JUDGED} SELECT count(*) AS n_rows, count(*) FILTER (errors <> '') AS quarantined, count(*) FILTER (errors = '' AND warnings <> '') AS warned FROM judged",
)
def dq_batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.totals(_judged(spark, sf_dir), PIPELINE.feeds["orders"].rules).select(F.col("rows").alias("n_rows"), "quarantined", "warned")


_ROW = "order_id, coalesce(customer_id, -1) AS customer_id, CAST(quantity AS BIGINT) AS quantity, CAST(amount AS DOUBLE) AS amount, status, CAST(order_date AS VARCHAR) AS order_date"


def _row() -> list:
    return [
        "order_id",
        F.coalesce("customer_id", F.lit(-1)).alias("customer_id"),
        F.col("quantity").cast("long").alias("quantity"),
        F.col("amount").cast("double").alias("amount"),
        "status",
        F.col("order_date").cast("string").alias("order_date"),
    ]


@query("dq_quarantine", f"{JUDGED} SELECT {_ROW}, errors FROM judged WHERE errors <> ''")
def dq_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where(quality.has_errors()).select(*_row(), F.array_join("_dq_errors", ",").alias("errors"))


@query("dq_valid", f"{JUDGED} SELECT {_ROW}, warnings FROM judged WHERE errors = ''")
def dq_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where(~quality.has_errors()).select(*_row(), F.array_join("_dq_warnings", ",").alias("warnings"))


@query(
    "dq_fk_lookup",
    f"WITH {ORDERS} SELECT order_id, coalesce(customer_id, -1) AS customer_id, EXISTS (SELECT 1 FROM customer AS k WHERE k.c_custkey = customer_id) AS found FROM dirty_orders",
)
def dq_fk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = next(r for r in PIPELINE.feeds["orders"].rules if isinstance(r, ForeignKey))
    found = quality.with_found(dirty_orders(spark, sf_dir), rule, _keys(spark, sf_dir)(*rule.referenced))
    return found.select("order_id", F.coalesce("customer_id", F.lit(-1)).alias("customer_id"), F.coalesce(rule.found, F.lit(False)).alias("found"))


@query(
    "dq_gate_decision",
    f"""{JUDGED}, b AS (SELECT order_id % 400 AS batch, count(*) AS n_rows, count(*) FILTER (errors <> '') AS bad FROM judged GROUP BY 1)
SELECT batch, n_rows, bad, CAST(bad AS DOUBLE) / n_rows AS ratio, n_rows >= 20 AND CAST(bad AS DOUBLE) / n_rows > 0.1 AS tripped FROM b""",
)
def dq_gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = _judged(spark, sf_dir).groupBy((F.col("order_id") % 400).alias("batch")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(quality.has_errors()).alias("bad"))
    return quality.gate_decisions(batches, 0.1, 20).withColumnRenamed("rows", "n_rows")


# ---------------------------------------------------------------- silver and bronze

_VERSIONS = f"""{JUDGED}, v AS (
  SELECT *, order_id % 5000 AS k FROM judged WHERE errors = ''
), n AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY modified_at DESC, order_id DESC) AS place FROM v)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid orders as versions of fewer keys."""
    return _judged(spark, sf_dir).where(~quality.has_errors()).withColumn("k", F.col("order_id") % 5000)


@query("silver_latest_valid", f"{_VERSIONS} SELECT k, order_id, status, CAST(amount AS DOUBLE) AS amount FROM n WHERE place = 1")
def silver_latest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest valid version of each key; an invalid newer one doesn't hide it."""
    return latest(_versions(spark, sf_dir), ["k"], ["modified_at", "order_id"]).select("k", "order_id", "status", F.col("amount").cast("double").alias("amount"))


def _month() -> Column:
    return F.date_format("order_date", "yyyy-MM")


@query(
    "silver_merge_pruned",
    f"""{JUDGED}, t AS (SELECT *, strftime(order_date, '%Y-%m') AS month FROM judged WHERE errors = ''),
s AS (SELECT * FROM t WHERE order_id % 10 <> 0), b AS (SELECT * FROM t WHERE (order_id % 10 = 0 OR order_id % 7 = 0) AND month LIKE '%-05')
SELECT month, count(*) AS n_rows, count(*) FILTER (changed) AS changed, sum(CAST(amount AS DOUBLE) * 100)::BIGINT AS cents FROM (
  SELECT coalesce(b.month, s.month) AS month, coalesce(b.amount + 1, s.amount) AS amount, b.order_id IS NOT NULL AS changed FROM s FULL OUTER JOIN b ON s.order_id = b.order_id)
GROUP BY month""",
)
def silver_merge_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts into a table that is partitioned by month; only the months that occur in the batch are rewritten."""
    rows = _judged(spark, sf_dir).where(~quality.has_errors()).withColumn("month", _month()).select("order_id", "month", "amount", "modified_at", F.lit(False).alias("changed"))
    table = Table(spark, scratch.folder(spark, "silver"))
    table.append(rows.where("order_id % 10 <> 0"), partition_by="month")
    newer = F.col("modified_at") + F.expr("INTERVAL 1 SECOND")
    batch = rows.where("(order_id % 10 = 0 OR order_id % 7 = 0) AND month LIKE '%-05'").withColumns({"amount": (F.col("amount") + 1).cast("decimal(12,2)"), "modified_at": newer, "changed": F.lit(True)})
    base = table.snapshot()
    units = table.touched(base, table.values_in(batch, "month", 1000))
    table.rewrite(base, units, changes.upserted(table.frame(base, units=units), batch, ["order_id"], "modified_at"), counts=changes.action_counts(), leave_out=["_action"])
    cents = F.sum((F.col("amount") * 100).cast("long")).alias("cents")
    return table.read().groupBy("month").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("changed").alias("changed"), cents)


_LOW, _HIGH = "2024-01-05 00:00:00.000000", "2024-01-20 12:00:00.000000"


@query("extract_window", f"SELECT event_id, user_id, event_type, value FROM events WHERE ts > TIMESTAMP '{_LOW}' AND ts <= TIMESTAMP '{_HIGH}'")
def extract_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").where(jdbc.in_window("ts", _LOW, _HIGH, "timestamp_ntz")).select("event_id", "user_id", "event_type", "value")


@query("extract_high_watermark", "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS high, min(event_id) AS low_key, max(event_id) AS high_key, count(*) AS n_rows FROM events")
def extract_high_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "events").agg(F.max("ts").alias("ts"), F.min("event_id").alias("low_key"), F.max("event_id").alias("high_key"), F.count(F.lit(1)).alias("n_rows"))
    return found.select(jdbc.as_text("ts").alias("high"), "low_key", "high_key", "n_rows")


@query("extract_replay_skip", "SELECT event_type, count(*) AS n_rows, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def extract_replay_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries, each of them twice: the second time nothing is written."""
    bronze = Drops(spark, scratch.folder(spark, "bronze"))
    events = _table(spark, sf_dir, "events")
    for seq in (1, 2, 3, 2, 1, 3):
        bronze.append(events.where(F.col("event_id") % 3 == seq - 1).select("event_id", "event_type"), seq)
    return bronze.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").alias("ids"))


# ---------------------------------------------------------------- change data

_OP = "CASE event_type WHEN 'signup' THEN 'c' WHEN 'error' THEN 'd' ELSE 'u' END"
_FOLD = f"""WITH e AS (SELECT *, {_OP} AS op FROM events), n AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM e
) SELECT user_id, event_type, value, event_id FROM n WHERE place = 1 AND op <> 'd'"""
_KEYS = ("user_id",)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    return _table(spark, sf_dir, "events").select("user_id", "event_type", "value", op.alias("_op"), F.col("event_id").alias("_cdc_offset"))


def _seen(table: DataFrame) -> DataFrame:
    return changes.visible(table).select("user_id", "event_type", "value", F.col("_cdc_offset").alias("event_id"))


def _fold_in(table: DataFrame | None, batch: DataFrame) -> DataFrame:
    last = changes.folded(batch, _KEYS)
    return last if table is None else changes.merged(table, last, _KEYS).drop("_action")


@query("cdc_latest_state", _FOLD)
def cdc_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(_fold_in(None, _changes(spark, sf_dir)))


def _batches(spark: SparkSession, sf_dir: str, order: list[int]) -> DataFrame:
    """Four batches by offset, folded in the given order."""
    log, table = _changes(spark, sf_dir), None
    top = F.broadcast(log.agg(F.max("_cdc_offset").alias("top")))  # one row
    numbered = log.join(top).withColumn("b", F.floor(F.col("_cdc_offset") * 4 / (F.col("top") + 1))).drop("top")
    for b in order:
        table = _fold_in(table, numbered.where(F.col("b") == b).drop("b"))
    return _seen(table)


@query("cdc_incremental_equals_fold", _FOLD)
def cdc_incremental_equals_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir, [0, 1, 2, 3])


@query("cdc_replay_noop", _FOLD)
def cdc_replay_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir, [0, 1, 2, 3, 3, 1])


@query("cdc_out_of_order", _FOLD)
def cdc_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir, [2, 0, 3, 1])


_HALVES = f"""WITH e AS (SELECT *, {_OP} AS op, event_id < (SELECT max(event_id) / 2 FROM events) AS early FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, early ORDER BY event_id DESC) AS place FROM e),
t AS (SELECT * FROM n WHERE early AND place = 1), s AS (SELECT * FROM n WHERE NOT early AND place = 1)"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = _changes(spark, sf_dir).join(F.broadcast(_table(spark, sf_dir, "events").agg(F.max("event_id").alias("top"))))
    early = F.col("_cdc_offset") < F.col("top") / 2
    return (changes.folded(log.where(c).drop("top"), _KEYS) for c in (early, ~early))


@query(
    "cdc_merge_counters",
    f"""{_HALVES}, a AS (SELECT CASE WHEN s.op = 'd' AND (t.op IS NULL OR t.op = 'd') THEN 'skipped' WHEN s.op = 'd' THEN 'deleted'
  WHEN t.op IS NULL OR t.op = 'd' THEN 'inserted' ELSE 'updated' END AS action FROM s LEFT JOIN t USING (user_id))
SELECT count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'deleted') AS deleted,
  count(*) FILTER (action = 'skipped') AS skipped, count(*) FILTER (action <> 'skipped') AS changed FROM a""",
)
def cdc_merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    return changes.counters(changes.merged(old, new, _KEYS))


@query(
    "cdc_partition_move",
    f"{_HALVES} SELECT s.user_id, t.event_type AS old_partition, s.event_type AS new_partition FROM s JOIN t USING (user_id) WHERE s.op <> 'd' AND t.op <> 'd' AND s.event_type <> t.event_type",
)
def cdc_partition_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a merge moves to another partition: one row each, in the new one."""
    old, new = _halves(spark, sf_dir)
    after = changes.visible(changes.merged(old, new, _KEYS)).select("user_id", F.col("event_type").alias("new_partition"))
    before = changes.visible(old).select("user_id", F.col("event_type").alias("old_partition"))
    return before.join(after, "user_id").where("old_partition <> new_partition")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").otherwise("u")
    image = F.struct(F.col("user_id"), F.col("event_type"), F.format_string("%.2f", "value").alias("value"), F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("day"))
    delete = F.col("event_type") == "error"
    text = envelope.rendered(F.when(delete, image), F.when(~delete, image), op, F.lit("users"), F.unix_millis(F.col("ts").cast("timestamp")))
    return _table(spark, sf_dir, "events").select(
        F.lit("app.shop.users").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"), text.alias("value")
    )


@query(
    "cdc_decode_envelope",
    f"SELECT 'users' AS tbl, {_OP} AS op, event_id AS pos, user_id, event_type, CAST(value AS DOUBLE) AS value, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events",
)
def cdc_decode_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = {"user_id": "long", "value": "decimal(12,2)", "day": "date"}
    decoded = envelope.decoded(_messages(spark, sf_dir))
    decoded = decoded.withColumn("_row", F.map_concat("_row", F.create_map(F.lit("tbl"), F.col("_table"))))
    rows = envelope.rows_of(decoded, types, ["tbl", "user_id", "event_type", "value", "day"])
    return rows.select(
        "tbl", F.col("_op").alias("op"), F.col("_cdc_offset").alias("pos"), "user_id", "event_type", F.col("value").cast("double").alias("value"), F.col("day").cast("string").alias("day")
    )


@query("cdc_field_discovery", "SELECT unnest(['day', 'event_type', 'user_id', 'value']) AS field")
def cdc_field_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(f,) for f in envelope.fields_of(envelope.decoded(_messages(spark, sf_dir)))], "field string")


@query("cdc_rejects", "SELECT event_id AS pos FROM events WHERE event_id % 11 = 0")
def cdc_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that are cut off, or whose operation is unknown."""
    broken = F.when(F.col("offset") % 2 == 0, F.expr("substring(value, 1, 20)")).otherwise(F.regexp_replace("value", '"op":"."', '"op":"t"'))
    messages = _messages(spark, sf_dir).withColumn("value", F.when(F.col("offset") % 11 == 0, broken).otherwise(F.col("value")))
    return envelope.rejected(messages).select(F.col("offset").alias("pos"))


@query(
    "cdc_event_validity",
    """SELECT event_id, concat_ws(',', CASE WHEN event_id % 13 = 0 THEN 'event_id is empty' END, CASE WHEN event_id % 17 = 0 THEN 'key is empty' END,
  CASE WHEN event_id % 19 = 0 THEN 'position is negative' END, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'a delete needs its row before' END) AS faults FROM events""",
)
def cdc_event_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    row = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"))
    delete = F.col("event_type") == "error"
    events = _table(spark, sf_dir, "events").select(
        e.alias("id"),
        F.when(e % 13 == 0, "").otherwise(e.cast("string")).alias("event_id"),
        F.lit("users").alias("table"),
        F.when(delete, "d").otherwise("u").alias("operation"),
        F.when(e % 17 == 0, F.create_map().cast("map<string,string>")).otherwise(row).alias("key"),
        F.when(delete & (e % 2 != 0), row).alias("before"),
        F.when(~delete, row).alias("after"),
        F.lit(0).alias("partition"),
        F.when(e % 19 == 0, F.lit(-1)).otherwise(e).alias("offset"),
    )
    return events.select(F.col("id").alias("event_id"), F.array_join(envelope.event_faults(), ",").alias("faults"))


@query("cdc_waiting_events", "SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0 ORDER BY event_id LIMIT 500")
def cdc_waiting_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 oldest events that are not processed: the bound of a batch is the feature."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id")
    return changes.waiting(events, events.where("event_id % 3 = 0"), 500, order="event_id")


@query("cdc_convergence", "SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right, 0::BIGINT AS unshared_columns")
def cdc_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in a shuffled order against one fold: no row differs."""
    found = changes.differences(_batches(spark, sf_dir, [3, 1, 0, 2]), cdc_latest_state(spark, sf_dir))
    return spark.createDataFrame([tuple(found.values())], "only_left long, only_right long, unshared_columns long")


@query("stream_available_now", f"SELECT user_id, event_type, value FROM ({_FOLD})")
def stream_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files that arrive in no particular order, in several triggers, into a replicated table."""
    root = scratch.folder(spark, "cdc")
    _messages(spark, sf_dir).repartition(4, F.xxhash64("offset")).write.parquet(f"{root}/in")
    targets = {"users": cdc.Target(("user_id",), {"user_id": "long", "value": "decimal(12,2)", "day": "date"}, buckets=4)}
    messages = cdc.messages_from_files(spark, f"{root}/in", per_trigger=2, pattern="*.parquet")
    cdc.replicate(messages, f"{root}/tables", targets, f"{root}/checkpoint", available_now=True).awaitTermination()
    return cdc.current(spark, f"{root}/tables/users").select("user_id", "event_type", F.col("value").cast("double").alias("value"))


@query("keys_never_valid", f"{JUDGED} SELECT DISTINCT customer_id FROM judged WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM judged WHERE errors = '')")
def keys_never_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    return changes.missing_keys(judged.where("customer_id is not null"), judged.where(~quality.has_errors()), ["customer_id"])


# ---------------------------------------------------------------- lake


@query("lake_history", "SELECT * FROM (VALUES (2, 'overwrite', 1, 2), (1, 'append', 1, 0), (0, 'append', 1, 0)) t(version, operation, units_added, units_removed)")
def lake_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lake(spark, sf_dir).history().select(F.col("version").cast("int"), "operation", F.col("units_added").cast("int"), F.col("units_removed").cast("int"))


def _lake(spark: SparkSession, sf_dir: str) -> Table:
    table, nations = Table(spark, scratch.folder(spark, "lake")), _table(spark, sf_dir, "nation")
    table.append(nations.where("n_nationkey < 10"), transaction=("load", 1))
    table.append(nations.where("n_nationkey < 10"), transaction=("load", 1))  # known: skipped
    table.append(nations.where("n_nationkey >= 10").withColumn("added", F.lit("new")), transaction=("load", 2))
    table.overwrite(nations.where("n_nationkey = 3"))
    return table


@query("lake_time_travel", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey >= 10 THEN 'new' END AS added FROM nation")
def lake_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version before an overwrite; a column that came later is null in older rows."""
    return _lake(spark, sf_dir).read(version=1).select("n_nationkey", "n_name", "added")


@query("lake_change_feed", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 10")
def lake_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lake(spark, sf_dir).inserted(0, 1).select("n_nationkey", "n_name")


@query("jdbc_window", "SELECT o_orderkey AS order_id, o_custkey AS customer_id FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '2000-06-01'")
def jdbc_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window over JDBC, read by four tasks; all orders are first loaded into a database."""
    conn, feed = _shop(spark, sf_dir)
    found = jdbc.read(spark, conn, feed, state.Window(1, "1996-01-01 00:00:00.0", "2000-06-01 00:00:00.0"))
    return found.select(F.col("ORDER_ID").alias("order_id"), F.col("CUSTOMER_ID").alias("customer_id"))


@query("jdbc_newest", "SELECT strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S.%f') AS high FROM orders")
def jdbc_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest watermark, asked of the database."""
    return spark.createDataFrame([(jdbc.high(spark, *_shop(spark, sf_dir)),)], "high string")


def _shop(spark: SparkSession, sf_dir: str) -> tuple[jdbc.Connection, spec.Feed]:
    """All orders in a Derby database, packed into an archive that driver and executors read.

    Derby lets one process at a time write a database, so the driver loads it, from files; any number may read an archive.
    """
    folder = scratch.folder(spark, "shop")
    at = Path(re.sub("^file:/+", "/", folder))
    if re.match(r"\w+:", str(at)):
        raise RuntimeError(f"Derby reads files only: {folder}")
    source = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp"))
    zone = spark._jvm.java.util.TimeZone.getDefault().getID()  # in which JDBC reads a timestamp
    source.write.options(timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS", timeZone=zone).csv(f"{folder}/orders")
    with (at / "orders.csv").open("wb") as out:  # one file into an empty table: nothing is logged
        for part in sorted(at.glob("orders/part-*")):
            with part.open("rb") as rows:
                shutil.copyfileobj(rows, out)
    shutil.rmtree(at / "orders")
    driver, properties = spark._jvm.org.apache.derby.iapi.jdbc.AutoloadedDriver(), spark._jvm.java.util.Properties()
    loading = driver.connect(f"jdbc:derby:directory:{at}/shop;create=true", properties)
    loading.createStatement().execute("CREATE TABLE ORDERS (ORDER_ID BIGINT, CUSTOMER_ID BIGINT, MODIFIED_AT TIMESTAMP)")
    loading.createStatement().execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'ORDERS', '{at}/orders.csv', NULL, NULL, 'UTF-8', 0)")
    loading.close()
    (at / "orders.csv").unlink()
    try:
        driver.connect(f"jdbc:derby:directory:{at}/shop;shutdown=true", properties)
    except Py4JJavaError as said:
        if said.java_exception.getSQLState() != "08006":  # so Derby says that it is done
            raise
    with zipfile.ZipFile(at / "shop.jar", "w") as jar:  # stored, for pages to be found by their place
        for path in sorted((at / "shop").rglob("*")):
            if path.suffix != ".lck":
                jar.write(path, path.relative_to(at))
    shutil.rmtree(at / "shop")
    conn = jdbc.Connection(f"jdbc:derby:jar:({at}/shop.jar)shop", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    return conn, spec.Feed("orders", "ORDERS", ("ORDER_ID",), "MODIFIED_AT", policy=spec.Policy(read_partitions=4))


# ---------------------------------------------------------------- control


@query(
    "schema_diff",
    """SELECT * FROM (VALUES ('added', 'loyalty', '', 'string', '+loyalty string'), ('dropped', 'c_acctbal', 'double', '', '-c_acctbal double (kept, NULL from now on)'),
  ('type_changed', 'c_nationkey', 'int', 'bigint', '~c_nationkey int -> bigint')) t(kind, column_name, old_type, new_type, description)""",
)
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = drift.types(_table(spark, sf_dir, "customer"))
    after = {c: t for c, t in before.items() if c != "c_acctbal"} | {"c_nationkey": "bigint", "loyalty": "string", "_run_id": "string"}
    return drift.as_table(spark, drift.between(before, after)).na.fill("").withColumnRenamed("column", "column_name")


@query(
    "plan_topology",
    """SELECT * FROM (VALUES (0, 'customers.extract', ''), (1, 'products.extract', ''), (2, 'orders.extract', ''), (3, 'customers.validate', 'customers.extract'),
  (4, 'products.validate', 'products.extract'), (5, 'orders.validate', 'orders.extract,customers.validate'), (6, 'run_report', 'customers.validate,products.validate,orders.validate')) t(place, task, upstream)""",
)
def plan_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    waits = graph.plan(PIPELINE)
    return spark.createDataFrame([(i, name, ",".join(waits[name])) for i, name in enumerate(graph.ordered(waits))], "place int, task string, upstream string")


@query(
    "next_window_cases",
    """SELECT * FROM (VALUES ('first', 1, '', '2024-01-02', false), ('idle', -1, '', '', false), ('newer', 4, '2024-01-02', '2024-01-03', false),
  ('pending', 4, '2024-01-02', '2024-01-09', true)) t(name, seq, low, high, recovered)""",
)
def next_window_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    never = state.blank("shop", "orders")
    third = state.done(state.noted(never, state.Window(3, None, "2024-01-02")))
    rows = []
    for name, known, top in (
        ("first", never, "2024-01-02"),
        ("idle", third, "2024-01-02"),
        ("newer", third, "2024-01-03"),
        ("pending", state.noted(third, state.Window(4, "2024-01-02", "2024-01-09")), "2024-01-12"),
    ):
        w = state.next_window(known, lambda top=top: top)
        rows.append((name, *((w.seq, w.low or "", w.high, w.recovered) if w else (-1, "", "", False))))
    return spark.createDataFrame(rows, "name string, seq int, low string, high string, recovered boolean")


_AUDIT = """audit AS (
  SELECT 'run' || (event_id // 60) AS run_id, CASE event_id % 3 WHEN 0 THEN 'customers' WHEN 1 THEN 'products' ELSE 'orders' END AS table_name,
    CASE WHEN event_id % 2 = 0 THEN 'extract' ELSE 'validate' END AS stage,
    CASE WHEN event_id % 41 = 0 THEN 'FAILED' WHEN event_id % 7 = 0 THEN 'NO_DATA' ELSE 'SUCCEEDED' END AS status, event_id AS batch_id, ts AS finished_at,
    event_id % 50 AS rows_read, event_id % 50 AS rows_written, event_id % 9 AS rows_quarantined, CASE WHEN event_id % 37 = 0 THEN '["+x int"]' ELSE '[]' END AS schema_changes,
    event_id % 4 AS f1, event_id % 5 AS f2, CASE WHEN event_id % 82 = 41 THEN 'batch refused: too much' WHEN event_id % 41 = 0 THEN 'ValueError: x' END AS error FROM events)"""


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _table(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), F.floor(e / 60)).alias("run_id"),
        F.when(e % 3 == 0, "customers").when(e % 3 == 1, "products").otherwise("orders").alias("table_name"),
        F.when(e % 2 == 0, "extract").otherwise("validate").alias("stage"),
        F.when(e % 41 == 0, "FAILED").when(e % 7 == 0, "NO_DATA").otherwise("SUCCEEDED").alias("status"),
        e.alias("batch_id"),
        F.col("ts").alias("finished_at"),
        (e % 50).alias("rows_read"),
        (e % 50).alias("rows_written"),
        (e % 9).alias("rows_quarantined"),
        F.when(e % 37 == 0, '["+x int"]').otherwise("[]").alias("schema_changes"),
        F.to_json(F.create_map(F.lit("f1"), e % 4, F.lit("f2"), e % 5)).alias("rule_failures"),
        F.when(e % 82 == 41, "batch refused: too much").when(e % 41 == 0, "ValueError: x").alias("error"),
    )


@query(
    "report_outcomes",
    f"""WITH {_AUDIT}, l AS (SELECT run_id, table_name, stage, arg_max(status, finished_at) AS status FROM audit GROUP BY ALL), p AS (
  SELECT run_id, table_name, max(status) FILTER (stage = 'extract') AS e, max(status) FILTER (stage = 'validate') AS v FROM l GROUP BY ALL)
SELECT CASE WHEN e = 'FAILED' OR v = 'FAILED' THEN 'failed' WHEN e IS NULL OR v IS NULL THEN 'not_run' WHEN e = 'NO_DATA' AND v = 'NO_DATA' THEN 'no_data' ELSE 'succeeded' END AS outcome,
  count(*) AS n FROM p GROUP BY 1""",
)
def report_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of tables in all runs: a run's table stands for a table here."""
    runs = _audit(spark, sf_dir).withColumn("table_name", F.concat_ws("/", "run_id", "table_name"))
    return reports.histogram(reports.outcomes(runs, runs.select("table_name").distinct()))


@query(
    "report_alerts",
    f"""WITH {_AUDIT} SELECT severity, alert, count(*) AS n FROM (
  SELECT 'critical' AS severity, 'stage failed' AS alert FROM audit WHERE status = 'FAILED'
  UNION ALL SELECT 'warning', 'quarantine ratio' FROM audit WHERE rows_read > 0 AND rows_quarantined / rows_read > 0.05
  UNION ALL SELECT 'info', 'schema changed' FROM audit WHERE schema_changes <> '[]'
  UNION ALL SELECT 'critical', 'pipeline failed' FROM (SELECT DISTINCT run_id FROM audit WHERE status = 'FAILED')) GROUP BY ALL""",
)
def report_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alerts(_audit(spark, sf_dir)).groupBy("severity", "alert").agg(F.count(F.lit(1)).alias("n"))


@query(
    "report_rule_totals",
    f"WITH {_AUDIT}, j AS (SELECT * FROM audit WHERE stage = 'validate' AND (status = 'SUCCEEDED' OR error LIKE 'batch refused%')) SELECT 'f1' AS rule, sum(f1)::BIGINT AS failures FROM j UNION ALL SELECT 'f2', sum(f2)::BIGINT FROM j",
)
def report_rule_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.rule_totals(_audit(spark, sf_dir))


@query(
    "report_pivot",
    f"""WITH {_AUDIT} SELECT run_id, (sum(rows_written) FILTER (table_name = 'customers'))::BIGINT AS customers, (sum(rows_written) FILTER (table_name = 'orders'))::BIGINT AS orders,
  (sum(rows_written) FILTER (table_name = 'products'))::BIGINT AS products FROM audit GROUP BY run_id""",
)
def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_run(_audit(spark, sf_dir), "rows_written", ["customers", "orders", "products"])


@query("report_kpis", "SELECT 'customers' AS name, count(*) AS n_rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'products', count(*) FROM part")
def report_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kpis(**{n: f(spark, sf_dir) for n, f in _INPUTS.items()}).withColumnRenamed("rows", "n_rows")


@query("report_newest_first", f"WITH {_AUDIT} SELECT run_id, batch_id FROM audit ORDER BY finished_at DESC")
def report_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest_first(_audit(spark, sf_dir)).select("run_id", "batch_id")


@query(
    "metrics_text",
    f"""{JUDGED}, n AS (
  SELECT count(*) AS n_rows, count(*) FILTER (errors <> '') AS bad, count(*) FILTER (errors = '' AND warnings <> '') AS warned, {", ".join(f"count(*) FILTER ({_fails_sql(r)}) AS {r}" for r in _ORDER_RULES)} FROM judged
), g AS (
  SELECT unnest([
    {{'m': 'sluice_stage_rows', 'l': ',kind="read"', 'v': n_rows}}, {{'m': 'sluice_stage_rows', 'l': ',kind="written"', 'v': n_rows - bad}}, {{'m': 'sluice_stage_rows', 'l': ',kind="quarantined"', 'v': bad}},
    {{'m': 'sluice_stage_rows', 'l': ',kind="warned"', 'v': warned}}, {{'m': 'sluice_stage_duration_seconds', 'l': '', 'v': 1.5}}, {{'m': 'sluice_stage_success', 'l': '', 'v': 1}},
    {{'m': 'sluice_stage_last_run_timestamp_seconds', 'l': '', 'v': 1704164645}}, {{'m': 'sluice_stage_last_success_timestamp_seconds', 'l': '', 'v': 1704164645}}, {{'m': 'sluice_schema_changes', 'l': '', 'v': 1}},
    {{'m': 'sluice_quarantine_ratio', 'l': '', 'v': bad / n_rows}}, {{'m': 'sluice_merge_files_rewritten', 'l': '', 'v': 7}}, {{'m': 'sluice_partitions_touched', 'l': '', 'v': 2}},
    {{'m': 'sluice_table_version', 'l': ',layer="silver"', 'v': 3}}, {{'m': 'sluice_table_version', 'l': ',layer="quarantine"', 'v': 2}},
    {", ".join(f"{{{{'m': 'sluice_dq_rule_failures', 'l': ',rule=\"{r}\",severity=\"{'warn' if r in _WARNINGS else 'error'}\"', 'v': {r}}}}}" for r in _ORDER_RULES).replace("{{", "{").replace("}}", "}")}]) AS g FROM n
), h AS (
  SELECT * FROM (VALUES ('sluice_stage_rows', 'Rows of a stage''s last run, by what became of them'), ('sluice_stage_duration_seconds', 'How long the last run took'), ('sluice_stage_success', 'Whether the last run went well'),
    ('sluice_stage_last_run_timestamp_seconds', 'When the last run ended'), ('sluice_stage_last_success_timestamp_seconds', 'When the last run that went well ended'), ('sluice_schema_changes', 'Schema changes that the last run met'),
    ('sluice_quarantine_ratio', 'The part of the last batch that went to quarantine'), ('sluice_merge_files_rewritten', 'Units that the last merge rewrote'), ('sluice_partitions_touched', 'Partitions that the last merge was limited to'),
    ('sluice_table_version', 'Versions of the layers that a run has written'), ('sluice_dq_rule_failures', 'Rows of the last batch that break a rule')) h(m, t)
)
SELECT '# HELP ' || m || ' ' || t AS line FROM h UNION ALL SELECT '# TYPE ' || m || ' gauge' FROM h
UNION ALL SELECT g.m || '{{pipeline="shop",table="orders",stage="validate"' || g.l || '}} ' || printf('%.6f', CAST(g.v AS DOUBLE)) FROM g""",
)
def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gauges of a validation of all orders, line by line."""
    rules = PIPELINE.feeds["orders"].rules
    found = quality.totals(_judged(spark, sf_dir), rules)
    whole = {"pipeline": "shop", "table_name": "orders", "stage": "validate", "status": "SUCCEEDED", "schema_changes": '["+x int"]', "partitions_touched": '["a", "b"]'}
    numbers = {"duration_ms": 1500, "files_rewritten": 7, "table_version": 3, "quarantine_version": 2}
    moment = F.lit("2024-01-02 03:04:05").cast("timestamp")
    run = found.select(
        *(F.lit(v).alias(k) for k, v in (whole | numbers).items()),
        moment.alias("started_at"),
        moment.alias("finished_at"),
        F.lit(None).cast("string").alias("watermark_to"),
        F.col("rows").alias("rows_read"),
        (F.col("rows") - F.col("quarantined")).alias("rows_written"),
        F.col("quarantined").alias("rows_quarantined"),
        F.col("warned").alias("rows_warned"),
        F.to_json("failures").alias("rule_failures"),
    )
    return metrics.exposition(metrics.of_stages(run, {r.name: r.severity for r in rules}))


@query(
    "metadata_rules",
    """SELECT * FROM (VALUES ('customers', 'pk_customer_id_not_null', 'not_null', 'error', true), ('customers', 'has_email', 'not_null', 'error', false), ('customers', 'email_has_host', 'regex', 'error', false),
  ('customers', 'country_code_of_two', 'length', 'error', false), ('customers', 'signed_up_by_now', 'not_future', 'warn', false), ('products', 'pk_product_id_not_null', 'not_null', 'error', true),
  ('products', 'sku_ends_in_digits', 'regex', 'error', false), ('products', 'price_in_range', 'range', 'error', false), ('products', 'known_category', 'allowed_values', 'error', false),
  ('orders', 'pk_order_id_not_null', 'not_null', 'error', true), ('orders', 'partition_order_date_not_null', 'not_null', 'error', true), ('orders', 'has_customer', 'not_null', 'error', false),
  ('orders', 'known_customer', 'foreign_key', 'error', false), ('orders', 'some_quantity', 'range', 'error', false), ('orders', 'amount_from_zero', 'range', 'error', false),
  ('orders', 'known_status', 'allowed_values', 'error', false), ('orders', 'ordered_by_now', 'not_future', 'error', false), ('orders', 'delivered_after_order', 'compare', 'warn', false)) t(table_name, rule, type, severity, implicit)""",
)
def metadata_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f.name, r.name, r.kind, r.severity, r.implicit) for f in PIPELINE.feeds.values() for r in f.rules]
    return spark.createDataFrame(rows, "table_name string, rule string, type string, severity string, implicit boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the names of the rules that they fail, and where they go."""
    return _judged(spark, sf_dir).select(
        "order_id", F.array_join("_dq_errors", ",").alias("errors"), F.array_join("_dq_warnings", ",").alias("warnings"), F.when(quality.has_errors(), "quarantine").otherwise("silver").alias("layer")
    )
