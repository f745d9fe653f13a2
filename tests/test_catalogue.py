"""Every named query against the other SQL engine, and under each execution preset."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.plans import ORACLE_SQL, QUERIES
from tessera.session import MODES, set_mode

DIRECTORY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIRECTORY).exists(), reason="the test tables are not here")


def normal(rows, order):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(value(row[i]) for i in order) for row in rows)


def rows_of(spark, name):
    frame = QUERIES[name](spark, DIRECTORY)
    return normal(frame.collect(), range(len(frame.columns)))


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in Path(DIRECTORY).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", QUERIES)
def test_same_rows(spark, oracle, name):
    frame = QUERIES[name](spark, DIRECTORY)
    expected = oracle.execute(ORACLE_SQL[name])
    names = [c[0] for c in expected.description]
    assert sorted(names) == sorted(frame.columns)
    got = normal(frame.collect(), [frame.columns.index(c) for c in sorted(names)])
    assert got == normal(expected.fetchall(), [names.index(c) for c in sorted(names)])


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("partitions", ["1", "16"])
def test_presets_agree(spark, mode, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    names = ["q1", "q3", "q5", "q13", "q19"]
    expected = {n: rows_of(spark, n) for n in names}
    try:
        set_mode(spark, mode)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        for n in names:
            assert rows_of(spark, n) == expected[n]
    finally:
        set_mode(spark, "hybrid")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_pushdown_and_pruning(spark):
    plan = QUERIES["q6"](spark, DIRECTORY)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in plan and "GreaterThanOrEqual(l_shipdate" in plan
    assert "l_comment" not in plan and "l_tax" not in plan
