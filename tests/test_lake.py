import threading
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sluice.operators.changes import upserted
from sluice.sources.drops import Drops
from sluice.sources.files import Files
from sluice.sources.lake import SUMMARY, CommitConflict, Table


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_versions_transactions_and_columns(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    assert not t.exists and t.version is None and t.schema_types() is None and t.last_metrics() == {}
    with pytest.raises(ValueError, match="no table"):
        t.read()
    a, b = spark.createDataFrame([(1, "x")], "id int, s string"), spark.createDataFrame([(2, "y", 0.5)], "id int, s string, n double")
    assert t.append(a, transaction=("load", 1), note={"run_id": "r"})
    assert not t.append(a, transaction=("load", 1)) and not t.append(a, transaction=("load", 0))
    assert t.append(b, transaction=("load", 2)) and t.append(a, transaction=("other", 0))
    assert rows(t.read(), "id", "n") == [(1, None), (1, None), (2, 0.5)]
    assert rows(t.read(version=0), "id") == [(1,)] and "n" not in t.read(version=0).columns
    assert rows(t.inserted(0, 2), "id") == [(1,), (2,)] and t.inserted(2, 2).isEmpty()
    assert t.entry(0)["note"] == {"run_id": "r"} and t.last_metrics()["rows"] == 1
    with pytest.raises(TypeError, match="'id' is int, not string"):
        t.append(spark.createDataFrame([("z",)], "id string"))
    with pytest.raises(ValueError, match="no version"):
        t.read(version=9)
    t.overwrite(a.limit(0))
    assert t.read().count() == 0 and rows(t.read(version=2), "id") == [(1,), (1,), (2,)]
    assert [r["operation"] for r in t.history().collect()] == ["overwrite", "append", "append", "append"]


def test_partitions_are_picked_from_the_log(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    values = ["2026-01-01", "a/b=c", "", None, "é"]
    t.append(spark.createDataFrame(list(enumerate(values)), "id int, p string"), partition_by="p")
    assert sorted(map(str, t.snapshot().units.values())) == sorted(map(str, values))
    for i, v in enumerate(values):
        assert rows(t.read(partitions=[v]), "id", "p") == [(i, v)]
    base = t.snapshot()
    units = t.touched(base, ["é"])
    new = upserted(t.frame(base, units=units), spark.createDataFrame([(4, "é"), (9, "é")], "id int, p string"), ["id"], "id")
    assert rows(new, "id", "_action") == [(4, "skipped"), (9, "inserted")]
    t.rewrite(base, units, new.drop("_action"))
    assert rows(t.read(), "id") == [(0,), (1,), (2,), (3,), (4,), (9,)]
    assert len([u for u in base.units if u in t.snapshot().units]) == 4
    assert t.vacuum(keep=1, older_than=0) == 0
    t.overwrite(spark.createDataFrame([(0, "z")], "id int, p string"))
    assert t.vacuum(keep=1) == 0  # too young
    assert t.vacuum(keep=1, older_than=0) == 2 and rows(t.read(), "id") == [(0,)]


def test_a_lost_race_is_a_conflict_and_append_retries(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1,)], "id int")
    base = t.snapshot()
    t.append(df)
    with pytest.raises(CommitConflict):
        t.commit("append", df, base=base)
    assert t.read().count() == 1
    threads = [threading.Thread(target=lambda: Table(spark, t.path).append(df)) for _ in range(3)]
    for th in threads:
        th.start()
    for th in threads:
        th.join()
    assert t.read().count() == 4 and t.version == 3


def test_long_history_is_read_from_its_summary(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1,)], "id int").coalesce(1)
    for _ in range(SUMMARY + 2):
        t.append(df)
    for v in range(SUMMARY):
        Files(spark).delete(f"{t.path}/_log/{v:020d}.json")
    assert t.read().count() == SUMMARY + 2


def test_drops(spark, tmp_path):
    d = Drops(spark, str(tmp_path / "d"))
    assert not d.exists and d.schema() is None
    with pytest.raises(ValueError, match="nothing in"):
        d.read()
    assert d.append(spark.range(3), 1) == 3 and d.append(spark.range(9), 1) is None
    assert d.append(spark.range(2).withColumn("x", F.lit("n")), 7) == 2
    assert d.numbers() == [1, 7] and d.types() == {"id": "bigint", "x": "string"}
    assert d.read().count() == 5 and d.read([7]).count() == 2 and d.read([5]).count() == 0
    assert d.read([1]).where("x is null").count() == 3
    assert Files(spark).names(f"{d.path}/_staging") == []


def test_unpublished_deliveries_are_not_seen(spark, tmp_path):
    d = Drops(spark, str(tmp_path / "d"))
    d.append(spark.range(3), 1)
    spark.range(5).write.parquet(f"{d.path}/_staging/crashed")
    seen = []
    q = d.stream().writeStream.foreachBatch(lambda b, i: seen.append(b.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [3]


def test_partition_values_of_any_type(spark, tmp_path):
    """Units are found by the partition's value whatever its type, so that a merge leaves no second version of a key."""
    for kind, values in {
        "boolean": (True, False, None),
        "double": (1e10, 0.1, float("nan")),
        "timestamp": (datetime(2024, 1, 1, 2, 3, 4, 500_000), datetime(1999, 12, 31), None),
        "decimal(10,2)": (Decimal("1.10"), Decimal("-3.00"), None),
        "date": (date(2024, 2, 29), date(1969, 12, 31), None),
        "bigint": (1 << 60, -1, 0),
    }.items():
        t = Table(spark, str(tmp_path / kind))
        schema = f"id int, part {kind}, w int"
        t.append(spark.createDataFrame([(i, v, 1) for i, v in enumerate(values)], schema), partition_by="part")
        batch = spark.createDataFrame([(0, values[0], 2), (9, values[2], 1)], schema)
        base = t.snapshot()
        units = t.touched(base, t.values_in(batch, "part", 10))
        assert len(units) == 2, kind
        t.rewrite(base, units, upserted(t.frame(base, units=units), batch, ["id"], "w"), leave_out=["_action"])
        assert sorted((r["id"], r["w"]) for r in t.read().collect()) == [(0, 2), (1, 1), (2, 1), (9, 1)], kind
        assert [r["id"] for r in t.read(partitions=[values[1]]).collect()] == [1], kind
        assert t.values_in(batch, "part", 1) is None


def test_a_late_writer_publishes_what_it_has_stored(spark, tmp_path, monkeypatch):
    t = Table(spark, str(tmp_path / "t"))
    t.append(spark.range(1).select(F.col("id").cast("int")))
    publish, lost, stored = Files.publish, [], []
    store = Table._stored

    def once(self, path, text):
        if not lost:
            lost.append(path)
            Table(spark, str(tmp_path / "t")).append(spark.range(5, 6).select(F.col("id").cast("int")))
        return publish(self, path, text)

    monkeypatch.setattr(Table, "_stored", lambda self, *a: (stored.append(1), store(self, *a))[1])
    monkeypatch.setattr(Files, "publish", once)
    assert t.append(spark.range(7, 8).select(F.col("id").cast("int")))
    assert len(stored) == 2 and t.version == 2 and sorted(r["id"] for r in t.read().collect()) == [0, 5, 7]
    assert len(t.files.names(f"{t.path}/data")) == 3


def test_one_of_many_publishes(spark, tmp_path):
    files = Files(spark)
    for k in range(20):
        path, won, ready = str(tmp_path / f"log/{k}.json"), [], threading.Barrier(4)

        def publish(i, path=path, won=won, ready=ready):
            ready.wait()
            if files.publish(path, str(i)):
                won.append(str(i))

        threads = [threading.Thread(target=publish, args=(i,)) for i in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert [files.read(path)] == won
