"""Replication against an evaluator that applies events one by one."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from sluice.functions import envelope
from sluice.operators import changes
from sluice.simulate import ChangeLog
from sluice.sources.lake import Table
from sluice.streaming import cdc

TARGETS = {
    "orders": cdc.Target(("order_id",), {"order_id": "long", "customer_id": "long", "amount": "decimal(12,2)", "order_date": "date"}, buckets=3),
    "customers": cdc.Target(("customer_id",), {"customer_id": "long"}, buckets=2),
}
LOG = "k int, v string, _op string, _cdc_offset long"


def one_by_one(events):
    table, known = {}, {}
    for k, v, op, offset in events:
        if offset > known.get(k, -1):
            known[k] = offset
            table.pop(k, None) if op == "d" else table.update({k: v})
    return table


def fold(spark, batches):
    table = None
    for batch in batches:
        last = changes.folded(spark.createDataFrame(batch, LOG), ["k"])
        table = last if table is None else changes.merged(table, last, ["k"]).drop("_action")
    return {r["k"]: r["v"] for r in changes.visible(table).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_any_order_and_replay_converge(spark, seed):
    rng = random.Random(seed)
    events = [(rng.randint(1, 6), f"v{i}", rng.choice("cuud"), i) for i in range(40)]
    batches = [events[i : i + 10] for i in range(0, 40, 10)]
    expected = one_by_one(events)
    assert fold(spark, batches) == expected
    assert fold(spark, [*batches, batches[-1]]) == expected
    rng.shuffle(batches)
    assert fold(spark, batches) == expected


def test_counters(spark):
    old = changes.folded(spark.createDataFrame([(1, "a", "c", 1), (2, "b", "c", 2), (3, "c", "d", 3)], LOG), ["k"])
    new = [(1, "x", "u", 9), (2, "b", "d", 9), (3, "y", "c", 9), (4, "z", "c", 9), (5, "q", "d", 9)]
    counts = lambda rows: changes.counters(changes.merged(old, changes.folded(spark.createDataFrame(rows, LOG), ["k"]), ["k"])).first().asDict()
    assert counts(new) == {"inserted": 2, "updated": 1, "deleted": 1, "skipped": 1, "changed": 4}
    assert counts([(1, "x", "u", 1), (3, "y", "u", 2)]) == {"inserted": 0, "updated": 0, "deleted": 0, "skipped": 2, "changed": 0}


def test_decoding_and_types(spark):
    messages = [
        ("a.b.t", json.dumps({"op": "c", "after": {"id": 1, "d": 20000, "n": "1.50", "x": "q"}})),
        ("a.b.t", json.dumps({"op": "d", "before": {"id": 2, "d": "2026-01-02", "n": "bad", "x": None}, "after": None})),
        ("a.b.t", json.dumps({"op": "t", "after": {"id": 3}})),
        ("a.b.t", "{not json"),
        ("a.b.t", json.dumps({"op": "u", "after": None})),
        ("a.b.t", None),
    ]
    df = spark.createDataFrame([(t, v, 0, i) for i, (t, v) in enumerate(messages)], "topic string, value string, partition int, offset long").withColumn("timestamp", F.lit("2026-01-01").cast("timestamp"))
    decoded = envelope.decoded(df)
    assert sorted((r["_op"], r["_table"], r["_offset"]) for r in decoded.collect()) == [("c", "t", 0), ("d", "t", 1)]
    assert sorted(r["offset"] for r in envelope.rejected(df).collect()) == [2, 3, 4, 5]
    assert envelope.fields_of(decoded) == ["d", "id", "n", "x"]
    rows = envelope.rows_of(decoded, {"id": "long", "d": "date", "n": "decimal(12,2)"}, ["d", "id", "n", "x"]).orderBy("id").collect()
    assert [(str(r["d"]), r["id"], None if r["n"] is None else str(r["n"]), r["x"]) for r in rows] == [("2024-10-04", 1, "1.50", "q"), ("2026-01-02", 2, None, None)]
    unsafe = spark.createDataFrame([({"a b": "1"},)], "_row map<string,string>")
    with pytest.raises(ValueError, match="unsafe"):
        envelope.fields_of(unsafe)


def test_guards(spark, tmp_path):
    log = ChangeLog()
    batch = envelope.decoded(log.frame(spark))
    with pytest.raises(KeyError, match="unknown table"):
        cdc.apply_batch(str(tmp_path), {"customers": TARGETS["customers"]}, batch, 0)
    with pytest.raises(ValueError, match="partitions"):
        cdc.apply_batch(str(tmp_path), TARGETS, batch.withColumn("_partition", F.lit(1)), 0)
    with pytest.raises(ValueError, match="lack key"):
        cdc.apply_batch(str(tmp_path), {**TARGETS, "customers": cdc.Target(("nope",))}, batch, 0)
    no_key = batch.where("_table = 'orders'").withColumn("_row", F.map_concat(F.map_filter("_row", lambda k, v: k != "order_id"), F.create_map(F.lit("order_id"), F.lit(None).cast("string"))))
    with pytest.raises(ValueError, match="no value"):
        cdc.apply_batch(str(tmp_path), TARGETS, no_key, 0)


def test_stream_of_files_in_any_order(spark, tmp_path):
    log = ChangeLog()
    log.burst(10)
    assert log.add_column() and not log.add_column()
    log.burst(15)
    starts = list(range(0, len(log.messages), 12))
    random.Random(3).shuffle(starts)
    for i in starts:
        log.frame(spark, i, i + 12).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    bad = spark.createDataFrame([("app.shop.orders", 0, 999, None, "{")], "topic string, partition int, offset long, timestamp timestamp, value string")
    bad.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    records = []
    stream = cdc.messages_from_files(spark, str(tmp_path / "in"), per_trigger=2, pattern="*.parquet")
    cdc.replicate(stream, str(tmp_path / "t"), TARGETS, str(tmp_path / "c"), available_now=True, records=records).awaitTermination()
    for name, target in TARGETS.items():
        got = {r[target.keys[0]]: r["status" if name == "orders" else "city"] for r in cdc.current(spark, str(tmp_path / "t" / name)).collect()}
        assert got == {k: v["status" if name == "orders" else "city"] for k, v in log.tables[name].items()}
    assert Table(spark, str(tmp_path / "t" / "_rejected")).read().count() == 1
    versions = {n: Table(spark, str(tmp_path / "t" / n)).version for n in TARGETS}
    replayed = cdc.apply_batch(str(tmp_path / "t"), TARGETS, envelope.decoded(log.frame(spark)), 99)
    assert all(r.replay for r in replayed) and all(Table(spark, str(tmp_path / "t" / n)).version >= v for n, v in versions.items())


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path, target = str(tmp_path / "t"), cdc.Target(("k",), buckets=8)
    cdc.merge(spark, path, target, spark.createDataFrame([(i, "a", "c", i) for i in range(100)], LOG))
    before = Table(spark, path).snapshot().units
    cdc.merge(spark, path, target, spark.createDataFrame([(5, "b", "u", 200)], LOG))
    after = Table(spark, path).snapshot().units
    assert len(set(before) - set(after)) == 1 and cdc.current(spark, path).count() == 100


def topics():
    """Stands in for the Kafka connector; made in a function, so that it travels to the reader's process as it is."""

    class Topics(DataSource):
        """Its columns, its options, a few messages."""

        @classmethod
        def name(cls):
            return "topics"

        def schema(self):
            return "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int"

        def simpleStreamReader(self, schema):
            return TopicsReader(self.options)

    class TopicsReader(SimpleDataSourceStreamReader):
        def __init__(self, options):
            assert (options["subscribePattern"], options["startingOffsets"], options["failOnDataLoss"]) == ("app[.].*", "earliest", "true")

        def initialOffset(self):
            return {"n": 0}

        def read(self, start):
            return self.readBetweenOffsets(start, {"n": 3}), {"n": 3}

        def readBetweenOffsets(self, start, end):
            def message(n):
                value = json.dumps({"before": None, "after": {"customer_id": str(n % 2), "name": f"v{n}"}, "source": {"table": "customers"}, "op": "u", "ts_ms": n})
                return (b"", value.encode(), "app.shop.customers", 0, n, datetime(2026, 1, 1), 0)

            return iter([message(n) for n in range(start["n"], end["n"])])

        def commit(self, end):
            pass

    return Topics


def test_a_connector_and_the_default_trigger(spark, tmp_path):
    """Messages of a connector are replicated by a stream that goes on."""
    spark.dataSource.register(topics())
    messages = cdc.messages_from_kafka(spark, "host:9092", "app[.].*", connector="topics")
    assert messages.columns == ["topic", "partition", "offset", "timestamp", "value"]
    stream = cdc.replicate(messages, str(tmp_path / "tables"), TARGETS, str(tmp_path / "checkpoint"))
    try:
        stream.processAllAvailable()
        assert stream.isActive
    finally:
        stream.stop()
    assert sorted((r["customer_id"], r["name"]) for r in cdc.current(spark, str(tmp_path / "tables/customers")).collect()) == [(0, "v2"), (1, "v1")]
    assert cdc.kafka_options("h:1", "x", 5)["maxOffsetsPerTrigger"] == "5" and "maxOffsetsPerTrigger" not in cdc.kafka_options("h:1", "x")
