"""Whole runs of the example pipeline over the simulated shop."""

import pytest
from pyspark.sql import functions as F

from sluice import audit
from sluice.extract import from_frames, read_state
from sluice.operators import changes, reports
from sluice.plans import state
from sluice.plans.drift import SILVER
from sluice.plans.spec import load_all
from sluice.runner import UPSTREAM_FAILED, outcome, reset, run_pipeline
from sluice.simulate import STOCK, Shop
from sluice.sources.drops import Drops
from sluice.sources.lake import Table
from sluice.streaming import checkpoints


class Crash(RuntimeError):
    pass


class Run:
    def __init__(self, spark, settings, **size):
        self.spark, self.settings, self.pipeline, self.n = spark, settings, load_all()["retail"], 0
        self.shop = Shop(self.pipeline, 11)
        self.shop.open(**({"customers": 8, "products": 4, "orders": 30, "days": 6} | size))

    def __call__(self, **options):
        self.n += 1
        source = from_frames(lambda t: self.shop.frame(self.spark, t))
        return run_pipeline(self.spark, self.pipeline, f"run{self.n}", self.settings, source, **{"as_of": self.shop.clock, **options})

    def table(self, layer, name):
        return Table(self.spark, getattr(self.settings.lake, layer)("retail", name))

    def silver(self, name):
        return self.table("silver", name).read()

    def state(self, name):
        return read_state(self.spark, self.settings.lake.control("retail", name), "retail", name)

    def defect(self, rule):
        return next(d for d in self.shop.defects if d.rule.name == rule)

    def agrees(self):
        """Silver has the shop's sound rows, value for value."""
        for name in self.pipeline.feeds:
            kept = self.shop.frame(self.spark, name).where(F.col(STOCK[name].key).isin([*self.shop.rows(name, sound=True)]))
            found = changes.differences(self.silver(name).drop(*SILVER), kept)
            assert found == {"only_left": 0, "only_right": 0, "unshared_columns": 0}, name


@pytest.fixture
def run(spark, lake):
    return Run(spark, lake)


def one(results, task):
    return results[task].entries[0]


def test_load_defects_idle_and_mend(run):
    assert outcome(run()) == "SUCCEEDED"
    run.agrees()
    for d in run.shop.defects:
        run.shop.spoil(d)
    second = run(threshold=1.0)
    assert outcome(second) == "SUCCEEDED"
    run.agrees()
    own = [d.rule for d in run.shop.defects if d.table == "orders"]
    orders = one(second, "orders.validate")
    assert orders["rule_failures"] == {r.name: 1 for r in own} and orders["rows_warned"] == 1 and orders["rows_quarantined"] == 8
    quarantined = run.table("quarantine", "orders").read()
    assert {tuple(r[0]) for r in quarantined.select("_dq_errors").collect()} == {(r.name,) for r in own if r.severity == "error"} and quarantined.count() == 8
    assert [r[0] for r in run.silver("orders").where(F.size("_dq_warnings") > 0).select("_dq_warnings").collect()] == [["delivered_after_order"]]
    versions = {t: run.table("silver", t).version for t in run.pipeline.feeds}
    third = run()
    assert {d.state for d in third.values()} == {"SUCCEEDED"} and {one(third, f"orders.{s}")["status"] for s in ("extract", "validate")} == {"NO_DATA"}
    assert versions == {t: run.table("silver", t).version for t in run.pipeline.feeds}
    assert run.shop.mend() == 16 and outcome(run()) == "SUCCEEDED"
    run.agrees()
    assert run.table("quarantine", "orders").read().count() == 8  # the history of what was rejected stays
    log = audit.records(run.spark, run.settings.lake.audit)
    assert {r["rule"]: r["failures"] for r in reports.rule_totals(log).collect()} == {d.rule.name: 1 for d in run.shop.defects}
    assert log.where("run_id = 'run3' and status = 'NO_DATA'").count() == 6


def test_a_crash_after_bronze_takes_the_same_window_again(run):
    def crash(task, point):
        if task == "orders.extract":
            raise Crash(point)

    failed = run(crash=crash)
    assert outcome(failed) == "FAILED" and failed["orders.validate"].state == UPSTREAM_FAILED and failed["orders.extract"].error == "Crash: bronze committed"
    noted = run.state("orders")
    assert state.unfinished(noted) and noted["planned_seq"] == 1
    run.shop.trade(20)  # newer rows must wait for the next window
    replay = one(run(), "orders.extract")
    assert replay["recovered"] and replay["rows_written"] == 0 and "already" in replay["note"] and replay["watermark_to"] == noted["planned_watermark"]
    assert outcome(run()) == "SUCCEEDED"
    run.agrees()
    assert Drops(run.spark, run.settings.lake.bronze("retail", "orders")).numbers() == [1, 2]


def test_a_crash_after_silver_writes_nothing_twice(run):
    run.shop.spoil(run.defect("amount_not_below_zero"))

    def crash(task, point):
        if task == "orders.validate":
            raise Crash(point)

    assert run(crash=crash)["orders.validate"].state == "FAILED"
    checkpoint = run.settings.lake.checkpoint("retail", "orders", "validate")
    assert checkpoints.pending(run.spark, checkpoint) == 0 and checkpoints.last_end(run.spark, checkpoint) is None
    version = run.table("silver", "orders").version
    replay = one(run(), "orders.validate")
    assert replay["recovered"] and replay["batch_id"] == 0 and replay["rows_written"] == 0 and "already" in replay["note"]
    assert run.table("silver", "orders").version == version and run.table("quarantine", "orders").read().count() == 1
    assert checkpoints.batches(run.spark, checkpoint).collect()[0]["committed"] and checkpoints.last_end(run.spark, checkpoint) == 0
    run.agrees()


def test_the_gate_keeps_silver_and_can_be_overruled(run):
    run()
    before = run.silver("orders").count()
    run.shop.flood()
    stopped = run()
    assert outcome(stopped) == "FAILED" and "24 of 24 rows for 'orders' are invalid" in stopped["orders.validate"].error
    assert stopped["run_report"].error == "not healthy: orders (failed)"
    assert run.silver("orders").count() == before and run.table("quarantine", "orders").read().count() == 24
    assert one(run(), "orders.validate")["recovered"]  # the batch waits
    assert outcome(run(threshold=1.0)) == "SUCCEEDED"
    assert run.table("quarantine", "orders").read().count() == 24
    run.agrees()


def test_a_few_bad_rows_pass(run):
    run()
    run.shop.flood(rows=3)
    assert outcome(run()) == "SUCCEEDED"
    run.agrees()


def test_columns_that_come_later(run):
    run()
    run.shop.widen("customers", "loyalty_tier")
    run.shop.happen("joined")
    assert one(run(), "customers.extract")["schema_changes"] == ["+loyalty_tier string"]
    assert "loyalty_tier" in run.silver("customers").columns
    run.shop.happen("joined")
    assert one(run(), "customers.extract")["schema_changes"] == []
    run.shop.widen("products", "weight_kg")
    run.shop.happen("stocked")
    refused = run()
    assert "policy fail" in refused["products.extract"].error
    assert refused["products.validate"].state == UPSTREAM_FAILED == refused["orders.validate"].state
    assert not state.unfinished(run.state("products"))


def test_a_merge_touches_the_days_of_its_rows_only(run):
    run()
    table = run.table("silver", "orders")
    before = dict(table.snapshot().units)
    row = next(r for r in run.shop.rows("orders").values() if r["order_date"] < run.shop.today)
    run.shop.write("orders", {"order_id": row["order_id"], "status": "PAID"})
    entry = one(run(), "orders.validate")
    assert entry["partitions_touched"] == [str(row["order_date"])] and entry["files_rewritten"] == 1
    left = {u for u in before if u in table.snapshot().units}
    assert {before[u] for u in set(before) - left} == {str(row["order_date"])}
    assert table.entry(table.version)["note"] == {"run_id": "run2", "batch_id": 1}


def test_reset(run):
    first = run()
    assert one(first, "orders.validate").line().startswith("retail/orders/validate: SUCCEEDED after ") and "read 30" in one(first, "orders.validate").line()
    assert len(reset(run.spark, run.pipeline, "orders", run.settings)) == 2
    assert not run.table("silver", "orders").exists
    assert outcome(run()) == "SUCCEEDED"
    run.agrees()


@pytest.mark.parametrize("seed", [1, 2])
def test_any_trade(run, seed):
    run.shop.rng.seed(seed)
    for _ in range(3):
        run.shop.trade(12)
        for d in run.shop.rng.sample(run.shop.defects, 2):
            run.shop.spoil(d)
        assert outcome(run(threshold=1.0)) == "SUCCEEDED"
        run.agrees()
