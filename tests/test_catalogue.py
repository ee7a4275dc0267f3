"""Every query against its SQL in DuckDB, at the smallest size."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sluice import catalogue, catalogue_runs  # noqa: F401
from sluice.__main__ import main

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        path = DATA / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    expected = [tuple(dict(zip(columns, r, strict=True))[c] for c in sorted(columns)) for r in found.fetchall()]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(rows, key=str) == sorted(expected, key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_filters_and_columns(spark):
    plan = catalogue.extract_window(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts" in plan and "LessThanOrEqual(ts" in plan and "props" not in plan.split("ReadSchema")[1]


def test_command_line(capsys, tmp_path):
    assert main(["validate-metadata"]) == 0 and "retail: 3 table(s)" in capsys.readouterr().out
    assert main(["plan", "--pipeline", "retail"]) == 0 and "orders.validate <- orders.extract" in capsys.readouterr().out
    assert main(["plan", "--pipeline", "nope"]) == 2 and main(["reset", "--pipeline", "retail", "--table", "orders"]) == 2
    assert main(["run", "--pipeline", "retail", "--table", "nope"]) == 2
    assert main(["--pipelines", str(tmp_path), "validate-metadata"]) == 1
    with pytest.raises(SystemExit) as fault:
        main(["run"])
    assert fault.value.code == 2


def test_jdbc_window_of_any_keys(spark, tmp_path):
    """Keys at both ends of their type, without a value and repeated."""
    name = "jdbc_window"
    rows = "(-9223372036854775808, 1), (-1, 2), (9223372036854775806, 3), (9223372036854775807, NULL), (NULL, 5), (7, 6), (7, 6)"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT k AS o_orderkey, c AS o_custkey, TIMESTAMP '1997-03-01 12:00:00' AS o_orderdate FROM (VALUES {rows}) t(k, c)")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet'")
    got = catalogue.QUERIES[name](spark, str(tmp_path)).select("order_id", "customer_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(catalogue.ORACLE_SQL[name]).fetchall(), key=str)


CLUSTER = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
conf = {"spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": f"file://{sys.argv[3]}"}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
entry.queries()[sys.argv[1]](spark, sys.argv[2]).write.parquet(f"file://{sys.argv[3]}/out")
"""


@pytest.mark.parametrize("name", ["jdbc_newest", "jdbc_window"])
def test_executors_apart_from_the_driver(duck, tmp_path, name):
    env = os.environ | {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13"}
    subprocess.run([sys.executable, "-c", CLUSTER, name, str(DATA), str(tmp_path)], check=True, timeout=300, env=env, cwd=tmp_path, capture_output=True)
    expected = duck.sql(catalogue.ORACLE_SQL[name])
    got = duck.sql(f"SELECT {', '.join(expected.columns)} FROM '{tmp_path}/out/*.parquet'")
    assert sorted(got.fetchall()) == sorted(expected.fetchall())
