"""More of the catalogue: queries that run the engine's parts together, and its control plane.

Importing this module adds them to ``catalogue.QUERIES``.  Where an outcome
doesn't depend on the tables, its twin states it as constants.
"""

from __future__ import annotations

import contextlib
import io
import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import audit, scratch, simulate
from sluice.catalogue import AS_OF, CUSTOMERS, ORDERS, PIPELINE, PRODUCTS, REJECTS, _fails_sql, _judged, _table, dirty_customers, dirty_orders, dirty_products, query
from sluice.extract import from_frames, read_state, run_extract, write_state
from sluice.functions import text
from sluice.layout import Lake, Settings
from sluice.operators import changes, quality
from sluice.plans import drift, graph, spec, state
from sluice.runner import reset, run_pipeline
from sluice.sources import jdbc
from sluice.sources.drops import Drops
from sluice.sources.lake import Table
from sluice.streaming import cdc, checkpoints
from sluice.streaming.validate import quarantined


def _lake(spark: SparkSession, name: str) -> Settings:
    return Settings(Lake(scratch.folder(spark, name)))


def _lines(spark: SparkSession, lines: list[str], column: str = "line") -> DataFrame:
    return spark.createDataFrame([(x,) for x in lines], f"{column} string")


# ---------------------------------------------------------------- whole runs


@query(
    "pipeline_audit",
    f"""WITH {ORDERS}, {CUSTOMERS}, {PRODUCTS}, c AS (
  SELECT customer_id, {" OR ".join(_fails_sql(r) for r in ("has_email", "email_has_host", "country_code_of_two"))} AS bad, {_fails_sql("signed_up_by_now")} AS odd FROM dirty_customers
), p AS (
  SELECT {" OR ".join(_fails_sql(r) for r in ("sku_ends_in_digits", "price_in_range", "known_category"))} AS bad, false AS odd FROM dirty_products
), o AS (
  SELECT {" OR ".join(_fails_sql(r) for r in ("partition_order_date_not_null", "has_customer", "some_quantity", "amount_from_zero", "known_status", "ordered_by_now"))}
    OR coalesce(customer_id NOT IN (SELECT customer_id FROM c WHERE NOT bad), false) AS bad, {_fails_sql("delivered_after_order")} AS odd
  FROM (SELECT * REPLACE (CAST(date_trunc('month', order_date) AS DATE) AS order_date) FROM dirty_orders)
), n AS (
  SELECT 'customers' AS t, count(*) AS n, count(*) FILTER (bad) AS b, count(*) FILTER (odd AND NOT bad) AS w FROM c UNION ALL SELECT 'products', count(*), count(*) FILTER (bad), 0 FROM p
  UNION ALL SELECT 'orders', count(*), count(*) FILTER (bad), count(*) FILTER (odd AND NOT bad) FROM o
)
SELECT 'run1' AS run_id, t AS table_name, 'extract' AS stage, 'SUCCEEDED' AS status, false AS recovered, n AS rows_read, n AS rows_written, 0 AS rows_quarantined, 0 AS rows_warned, '' AS error FROM n
UNION ALL SELECT 'run1', t, 'validate', CASE t WHEN 'orders' THEN 'FAILED' ELSE 'SUCCEEDED' END, false, n, n - b, b, w, CASE t WHEN 'orders' THEN 'RuntimeError: silver merged' ELSE '' END FROM n
UNION ALL SELECT 'run1', '*', 'report', 'FAILED', false, 0, 0, 0, 0, 'not healthy: orders (failed)'
UNION ALL SELECT 'run2', t, 'extract', 'NO_DATA', false, 0, 0, 0, 0, '' FROM n
UNION ALL SELECT 'run2', t, 'validate', 'NO_DATA', false, 0, 0, 0, 0, '' FROM n WHERE t <> 'orders'
UNION ALL SELECT 'run2', t, 'validate', 'SUCCEEDED', true, n, 0, b, w, '' FROM n WHERE t = 'orders'
UNION ALL SELECT 'run2', '*', 'report', 'SUCCEEDED', false, 0, 0, 0, 0, ''""",
)
def pipeline_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of all tasks; the first ends right after the merge of orders, the second takes that batch again and writes nothing twice.

    Orders are dated by month here, as each date is a partition.
    """
    settings = _lake(spark, "runs")
    orders = dirty_orders(spark, sf_dir).withColumn("order_date", F.trunc("order_date", "MM"))
    frames = {"customers": dirty_customers(spark, sf_dir), "products": dirty_products(spark, sf_dir), "orders": orders}
    source = from_frames(frames.__getitem__)

    def crash(task: str, point: str) -> None:
        if task == "orders.validate":
            raise RuntimeError(point)

    run_pipeline(spark, PIPELINE, "run1", settings, source, as_of=AS_OF, threshold=1.0, crash=crash)
    run_pipeline(spark, PIPELINE, "run2", settings, source, as_of=AS_OF, threshold=1.0)
    columns = ["run_id", "table_name", "stage", "status", "recovered", "rows_read", "rows_written", "rows_quarantined", "rows_warned"]
    return audit.records(spark, settings.lake.audit).select(*columns, F.coalesce("error", F.lit("")).alias("error"))


_EVENTS = spec.Feed("events", "app.events", ("event_id",), "ts")
_CUT = "2024-01-15 00:00:00"


@query(
    "extract_windows",
    f"""SELECT CASE WHEN ts <= TIMESTAMP '{_CUT}' THEN 1 ELSE 2 END AS _extract_seq, CASE WHEN ts <= TIMESTAMP '{_CUT}' THEN 'run1' ELSE 'run2' END AS _run_id, count(*) AS n_rows,
  sum(event_id)::BIGINT AS ids, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS watermark, 'event_id,event_type,ts,_run_id,_extract_seq,_ingested_at,_ingest_date' AS columns FROM events GROUP BY ALL""",
)
def extract_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows of a source that grows, the first of which is interrupted after its write and taken again."""
    settings, pipeline = _lake(spark, "windows"), spec.Pipeline("p", "c", {"events": _EVENTS})
    events = _table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))

    def stop(point: str) -> None:
        raise RuntimeError(point)

    early = from_frames(lambda table: events.where(F.col("ts") <= F.lit(_CUT).cast("timestamp")))
    run_extract(spark, pipeline, _EVENTS, "run1", settings, early, stop)
    for source in (from_frames(lambda table: events), from_frames(lambda table: events), from_frames(lambda table: events)):
        run_extract(spark, pipeline, _EVENTS, "run2", settings, source)  # finishes the first window, takes the second, finds no third
    known = read_state(spark, settings.lake.control("p", "events"), "p", "events")
    bronze = Drops(spark, settings.lake.bronze("p", "events"))
    found = bronze.read().groupBy("_extract_seq", "_run_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").alias("ids"), F.max("ts").alias("ts"))
    assert known["committed_seq"] == 2 and not state.unfinished(known)
    return found.select("_extract_seq", "_run_id", "n_rows", "ids", jdbc.as_text("ts").alias("watermark"), F.lit(",".join(bronze.types())).alias("columns"))


@query(
    "quarantine_append",
    f"""WITH {ORDERS}, j AS (SELECT order_id, {" OR ".join(_fails_sql(r) for r in REJECTS if r in ("partition_order_date_not_null", "has_customer", "known_customer", "some_quantity", "amount_from_zero", "known_status", "ordered_by_now"))} AS bad FROM dirty_orders)
SELECT order_id % 3 AS batch_id, count(*) AS n_rows, sum(order_id)::BIGINT AS ids, 'run' || (order_id % 3) AS noted FROM j WHERE bad GROUP BY ALL""",
)
def quarantine_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of rejected rows, each of them twice; the lineage of each commit beside its rows."""
    table = Table(spark, scratch.folder(spark, "quarantine"))
    rows = quality.without_flags(_judged(spark, sf_dir), PIPELINE.feeds["orders"].rules)
    rows = rows.withColumns({"_run_id": F.lit("r"), "_extract_seq": F.lit(1).cast("long"), "_ingested_at": F.col("modified_at")})
    for batch in (0, 1, 1, 2, 0, 2):
        entry = audit.Entry(f"run{batch}", "shop", "orders", "validate").note(batch_id=batch)
        own = quarantined(rows.where(F.col("order_id") % 3 == batch), ["order_id"], entry)
        table.append(own, transaction=("quarantine", batch), note={"run_id": entry["run_id"], "batch_id": batch})
    notes = table.history().select(F.get_json_object("note", "$.batch_id").cast("long").alias("_batch_id"), F.get_json_object("note", "$.run_id").alias("noted"))
    found = table.read().groupBy("_batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("order_id").alias("ids"))
    return found.join(notes, "_batch_id").withColumnRenamed("_batch_id", "batch_id")


@query("lake_reset", "SELECT * FROM (VALUES ('bronze', true), ('checkpoint', false), ('quarantine', false), ('silver', false), ('control', true)) t(layer, left_over)")
def lake_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reset leaves of a table."""
    settings = _lake(spark, "reset")
    nations = _table(spark, sf_dir, "nation")
    place = {layer: getattr(settings.lake, layer)("shop", "orders") for layer in ("bronze", "silver", "quarantine", "control")} | {"checkpoint": settings.lake.checkpoint("shop", "orders", "validate")}
    Drops(spark, place["bronze"]).append(nations, 1)
    for layer in ("silver", "quarantine", "control"):
        Table(spark, place[layer]).append(nations)
    files = Table(spark, place["silver"]).files
    files.publish(f"{place['checkpoint']}/offsets/0", "v1")
    reset(spark, PIPELINE, "orders", settings)
    return spark.createDataFrame([(layer, files.exists(path)) for layer, path in place.items()], "layer string, left_over boolean")


@query("journal_conflicts", "SELECT 'run' || i AS run_id, 4 AS versions FROM range(4) t(i)")
def journal_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four writers append to one journal at once; those that are slower try again."""
    path = scratch.folder(spark, "journal")
    entries = [audit.Entry(f"run{i}", "p", "t", "extract").end() for i in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda e: audit.append(spark, path, [e]), entries))
    return audit.records(spark, path).select("run_id", F.lit(len(Table(spark, path).versions())).alias("versions"))


_KINDS = {
    "boolean": ("event_id % 2 = 0", "event_id % 2 = 0"),
    "double": ("CAST((event_id % 4) * 1.0E9 + 0.5 AS DOUBLE)", "CAST((event_id % 4) * 1.0E9 + 0.5 AS DOUBLE)"),
    "timestamp": ("date_trunc('DAY', ts) + INTERVAL 1 SECOND * 0.25", "date_trunc('day', ts) + INTERVAL 250 MILLISECONDS"),
}


@query(
    "lake_merge_by_type",
    " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, count(*) AS n_rows, count(DISTINCT event_id) AS n_keys, count(*) FILTER (event_id % 10 = 0) AS changed, count(DISTINCT {sql}) AS n_partitions FROM events" for kind, (_, sql) in _KINDS.items()
    ),
)
def lake_merge_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned merges into tables that are partitioned by values of several types: every key is there once."""
    out = None
    for kind, (part, _) in _KINDS.items():
        rows = _table(spark, sf_dir, "events").select("event_id", F.expr(part).alias("part"), F.lit(1).alias("w"))
        table = Table(spark, scratch.folder(spark, kind))
        table.append(rows, partition_by="part")
        batch, base = rows.where("event_id % 10 = 0").withColumn("w", F.lit(2)), table.snapshot()
        units = table.touched(base, table.values_in(batch, "part", 1000))
        table.rewrite(base, units, changes.upserted(table.frame(base, units=units), batch, ["event_id"], "w"), leave_out=["_action"])
        counts = (F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_keys"), F.count_if(F.col("w") == 2).alias("changed"), F.count_distinct("part").alias("n_partitions"))
        found = table.read().agg(*counts).select(F.lit(kind).alias("kind"), "*")
        out = found if out is None else out.unionByName(found)
    return out


# ---------------------------------------------------------------- streams

_SIDES = {"users": "event_type <> 'error'", "faults": "event_type = 'error'"}


@query("stream_tables", "SELECT CASE WHEN event_type = 'error' THEN 'faults' ELSE 'users' END AS tbl, user_id, max(event_id) AS pos FROM events GROUP BY ALL")
def stream_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes for two tables in each batch of a stream with the default trigger, which goes on until it is stopped."""
    root = scratch.folder(spark, "tables")
    image = F.to_json(F.struct(F.struct("user_id", F.col("event_id").alias("pos")).alias("after"), F.lit("u").alias("op")))
    topic = F.concat(F.lit("app.shop."), F.when(F.col("event_type") == "error", "faults").otherwise("users"))
    messages = _table(spark, sf_dir, "events").select(topic.alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"), image.alias("value"))
    messages.repartition(4).write.parquet(f"{root}/in")
    targets = {t: cdc.Target(("user_id",), {"user_id": "long", "pos": "long"}, buckets=2) for t in _SIDES}
    stream = cdc.replicate(cdc.messages_from_files(spark, f"{root}/in", per_trigger=2, pattern="*.parquet"), f"{root}/tables", targets, f"{root}/checkpoint")
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    users, faults = (cdc.current(spark, f"{root}/tables/{t}").select(F.lit(t).alias("tbl"), "user_id", "pos") for t in _SIDES)
    return users.unionByName(faults)


@query("stream_checkpoint", "SELECT * FROM (VALUES (0, true, 2, 20), (1, true, 2, 30), (2, true, 2, 40)) t(batch_id, committed, last_end, rows_seen)")
def stream_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deliveries as three batches, and what the checkpoint says of them."""
    root = scratch.folder(spark, "deliveries")
    bronze, seen = Drops(spark, f"{root}/bronze"), {}
    for n in (1, 2, 3):
        bronze.append(spark.range(10 * n + 10).coalesce(1), n)
    writer = bronze.stream(per_trigger=1).writeStream.foreachBatch(lambda batch, i: seen.update({int(i): batch.count()})).option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    rows = [(r["batch_id"], r["committed"], checkpoints.last_end(spark, f"{root}/checkpoint"), seen[r["batch_id"]]) for r in checkpoints.batches(spark, f"{root}/checkpoint").collect()]
    return spark.createDataFrame(rows, "batch_id int, committed boolean, last_end int, rows_seen int")


@query(
    "cdc_guards",
    """SELECT * FROM (VALUES ('null key', 'ValueError'), ('other partition', 'ValueError'), ('no key column', 'ValueError'), ('unknown table', 'KeyError'), ('unsafe name', 'ValueError'), ('sound', '')) t(what, refused_by)""",
)
def cdc_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that a replicated table must not take."""
    batches = {
        "null key": ("users", 0, {"id": None, "v": "a"}),
        "other partition": ("users", 1, {"id": "1"}),
        "no key column": ("users", 0, {"v": "a"}),
        "unknown table": ("others", 0, {"id": "1"}),
        "unsafe name": ("users", 0, {"id": "1", "a; b": "x"}),
        "sound": ("users", 0, {"id": "1", "v": "a"}),
    }
    rows, root = [], scratch.folder(spark, "guards")
    for what, (table, partition, image) in batches.items():
        one = [(table, "u", image, partition, 0, datetime(2024, 1, 1))]
        batch = spark.createDataFrame(one, "_table string, _op string, _row map<string,string>, _partition int, _offset long, _timestamp timestamp")
        try:
            cdc.apply_batch(f"{root}/{len(rows)}", {"users": cdc.Target(("id",))}, batch, 0)
            rows.append((what, ""))
        except (ValueError, KeyError) as fault:
            rows.append((what, type(fault).__name__))
    return spark.createDataFrame(rows, "what string, refused_by string")


@query("cdc_simulated", "SELECT * FROM (VALUES ('orders', 0, 0), ('customers', 0, 0)) t(tbl, only_left, only_right)")
def cdc_simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simulator's change stream, folded in two halves that come in the wrong order, against the simulator's own tables."""
    log = simulate.ChangeLog(5)
    log.burst(30)
    log.add_column()
    log.burst(10)
    targets = {t: cdc.Target((key,), {key: "long", "customer_id": "long"}, buckets=2) for t, key in log.KEYS.items()}
    root, half = scratch.folder(spark, "simulated"), len(log.messages) // 2
    for n, part in enumerate((log.frame(spark, half), log.frame(spark, 0, half))):
        cdc.apply_batch(root, targets, cdc.envelope.decoded(part), n)
    rows = []
    for name, own in log.tables.items():
        columns = sorted({c for r in own.values() for c in r})
        expected = spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in columns) for r in own.values()], ", ".join(f"{c} string" for c in columns))
        got = cdc.current(spark, f"{root}/{name}").select(*(F.col(c).cast("string") for c in columns))
        found = changes.differences(got, expected)
        rows.append((name, found["only_left"], found["only_right"]))
    return spark.createDataFrame(rows, "tbl string, only_left int, only_right int")


# ---------------------------------------------------------------- control plane


@query(
    "control_record",
    """SELECT * FROM (VALUES (0, 'noted', 0, 1, '', '2024-01-02', true), (1, 'done', 1, 1, '2024-01-02', '2024-01-02', false), (2, 'noted', 1, 2, '2024-01-02', '2024-01-05', true),
  (3, 'done', 2, 2, '2024-01-05', '2024-01-05', false)) t(version, step, committed_seq, planned_seq, committed_watermark, planned_watermark, unfinished)""",
)
def control_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored row of a table over two windows, version by version."""
    path, steps = scratch.folder(spark, "control"), []
    row = state.blank("shop", "orders")
    for top in ("2024-01-02", "2024-01-05"):
        row = state.noted(row, state.next_window(row, lambda top=top: top))
        write_state(spark, path, row)
        row = state.done(row, {"id": "int"})
        write_state(spark, path, row)
    for v in range(4):
        r = Table(spark, path).read(version=v).first()
        steps.append((v, ("noted", "done")[v % 2], r["committed_seq"], r["planned_seq"], r["committed_watermark"] or "", r["planned_watermark"], state.unfinished(r)))
    return spark.createDataFrame(steps, "version int, step string, committed_seq int, planned_seq int, committed_watermark string, planned_watermark string, unfinished boolean")


@query(
    "drift_policies",
    """SELECT policy, kind, kind <> 'type_changed' AND policy <> 'fail' AS taken FROM (VALUES ('add_new_columns'), ('fail')) p(policy), (VALUES ('added'), ('dropped'), ('type_changed')) k(kind)""",
)
def drift_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.between({"a": "int", "b": "int"}, {"a": "bigint", "c": "int"})
    rows = [(policy, d.kind, not drift.refused([d], policy)) for policy in ("add_new_columns", "fail") for d in found]
    return spark.createDataFrame(rows, "policy string, kind string, taken boolean")


_FAULTY = {
    "shape": {"pipeline": "P", "tables": []},
    "rules": {
        "pipeline": "p",
        "source": {"type": "jdbc", "connection": "c"},
        "tables": [
            {
                "name": "t",
                "source_table": "s.t",
                "primary_key": ["id"],
                "watermark_column": "w",
                "rules": [
                    {"name": "r", "type": "range", "column": "x", "min": 3, "max": 2},
                    {"name": "q", "type": "regex", "column": "x", "pattern": "(?<=a)b"},
                    {"name": "f", "type": "foreign_key", "column": "x", "references": {"table": "u", "column": "id"}},
                    {"name": "f", "type": "compare", "column": "x", "operator": "<", "other_column": "x"},
                ],
            }
        ],
    },
}


@query(
    "spec_problems",
    """SELECT * FROM (VALUES ('shape: /: ''source'' is a required property'), ('shape: /pipeline: ''P'' does not match ^[a-z][a-z0-9_]*$'), ('shape: /tables: needs 1 item(s) or more'),
  ('rules: /tables/0 (t): two rules are called ''f'''), ('rules: /tables/0 (t): r: nothing lies between 3 and 2'),
  ('rules: /tables/0 (t): q: a pattern may have no lookaround, named group, back reference or possessive quantifier: engines differ on them'),
  ('rules: /tables/0 (t): f: there is no table ''u'' to refer to'), ('rules: /tables/0 (t): f: a column is compared with itself')) t(line)""",
)
def spec_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is wrong with two documents."""
    return _lines(spark, [f"{name}: {p}" for name, document in _FAULTY.items() for p in spec.problems(document)])


@query(
    "spec_settings",
    """SELECT * FROM (VALUES ('retail', 'customers', 'add_new_columns', 0.3::DOUBLE, 20, 1, 5), ('retail', 'products', 'fail', 0.3, 20, 1, 4), ('retail', 'orders', 'add_new_columns', 0.3, 20, 4, 10))
t(pipeline, table_name, schema_evolution, quarantine_threshold, gate_min_rows, read_partitions, n_rules)""",
)
def spec_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The example documents, with the settings that each table ends up with."""
    rows = [(p.name, f.name, *vars(f.policy).values(), len(f.rules)) for p in spec.load_all().values() for f in p.feeds.values()]
    return spark.createDataFrame(rows, "pipeline string, table_name string, schema_evolution string, quarantine_threshold double, gate_min_rows int, read_partitions int, n_rules int")


@query(
    "task_schedule",
    """SELECT * FROM (VALUES ('customers.extract', 'run --pipeline shop --table customers --stage extract', 2, false), ('customers.validate', 'run --pipeline shop --table customers --stage validate', 2, false),
  ('products.extract', 'run --pipeline shop --table products --stage extract', 2, false), ('products.validate', 'run --pipeline shop --table products --stage validate', 2, false),
  ('orders.extract', 'run --pipeline shop --table orders --stage extract', 2, false), ('orders.validate', 'run --pipeline shop --table orders --stage validate', 2, false),
  ('run_report', 'report --pipeline shop', 1, true)) t(task, command, tries, always)""",
)
def task_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scheduler is told of each task."""
    rows = [(n, t["command"].removeprefix("python -m sluice ").removesuffix(" --run-id r"), t["tries"], t["always"]) for n, t in graph.schedule(PIPELINE, "r").items()]
    return spark.createDataFrame(rows, "task string, command string, tries int, always boolean")


@query("command_line", "SELECT * FROM (VALUES ('validate-metadata', 0, 'retail: 3 table(s), 19 rule(s)'), ('plan', 0, 'customers.extract <- -'), ('plan --pipeline nope', 2, ''), ('reset', 2, '')) t(command, status, first_line)")
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status and the first line of some commands."""
    from sluice.__main__ import main

    rows = []
    for name, words in {"validate-metadata": [], "plan": ["--pipeline", "retail"], "plan --pipeline nope": [], "reset": ["--pipeline", "retail", "--table", "orders"]}.items():
        said = io.StringIO()
        with contextlib.redirect_stdout(said), contextlib.redirect_stderr(io.StringIO()):
            status = main([*name.split(), *words])
        rows.append((name, status, said.getvalue().partition("\n")[0]))
    return spark.createDataFrame(rows, "command string, status int, first_line string")


@query(
    "jdbc_text",
    """SELECT * FROM (VALUES ('ansi', '"s"."t"', '"modified_at" > {ts ''2024-01-01 00:00:00.0''} AND "modified_at" <= {ts ''2024-01-02 00:00:00.0''}'),
  ('tsql', '[s].[t]', '[modified_at] > CAST(''2024-01-01 00:00:00.0'' AS DATETIME2(7)) AND [modified_at] <= CAST(''2024-01-02 00:00:00.0'' AS DATETIME2(7))'),
  ('refused', '2024-01-01; DROP', 'ValueError')) t(dialect, source, condition)""",
)
def jdbc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window as the text that a database gets; what isn't a timestamp is refused."""
    feed, w = spec.Feed("t", "s.t", ("id",), "modified_at"), state.Window(1, "2024-01-01 00:00:00.0", "2024-01-02 00:00:00.0")
    rows = [(d, text.name(feed.source, d), jdbc.predicate(feed, w, d)) for d in ("ansi", "tsql")]
    try:
        jdbc.predicate(feed, w._replace(low="2024-01-01; DROP"))
    except ValueError as fault:
        rows.append(("refused", "2024-01-01; DROP", type(fault).__name__))
    return spark.createDataFrame(rows, "dialect string, source string, condition string")


@query(
    "shop_defects",
    """SELECT unnest(['has_email', 'email_looks_right', 'two_letter_country', 'signed_up_by_now', 'sku_looks_right', 'price_is_sensible', 'known_shelf', 'partition_order_date_not_null', 'has_customer',
  'known_customer', 'known_product', 'quantity_is_sensible', 'amount_not_below_zero', 'known_status', 'ordered_by_now', 'delivered_after_order']) AS rule, 1 AS failures""",
)
def shop_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A simulated shop with one defect of each kind: every rule fails once, and on nothing else."""
    pipeline = spec.load_all()["retail"]
    shop = simulate.Shop(pipeline, 3)
    shop.open(customers=10, products=5, orders=40)
    shop.trade(20)
    for defect in shop.defects:
        shop.spoil(defect)
    rows = []
    for name, feed in pipeline.feeds.items():
        keys = lambda table, column: shop.frame(spark, table).select(column)
        found = quality.totals(quality.judged(shop.frame(spark, name), feed.rules, shop.clock, keys), feed.rules).first()["failures"]
        rows += [(rule, n) for rule, n in found.items() if n]
    return spark.createDataFrame(rows, "rule string, failures int")


@query("example_document", "SELECT 'retail' AS pipeline, 'shop' AS connection, 10000 AS fetch_size, '*/10 * * * *' AS schedule, 'orders' AS last_table, 'customers,products' AS needs")
def example_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a loaded document says of its source and its last table."""
    p = spec.load_all()["retail"]
    last = [*p.feeds.values()][-1]
    assert json.loads(open(p.origin, encoding="utf-8").read())["pipeline"] == p.name
    return spark.createDataFrame([(p.name, p.connection, p.fetch_size, p.schedule, last.name, ",".join(last.needs()))], "pipeline string, connection string, fetch_size int, schedule string, last_table string, needs string")
