"""Whole queries over some millions of rows, under each execution preset and with few and many partitions, down to the text that is printed."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import with_constant
from tessera.operators import aggregate, equi_join, filter_keep, project, scan
from tessera.session import MODES, set_mode
from tessera.sources import format_rows
from tessera.sources.sinks import as_lines


@pytest.fixture(params=list(MODES))
def preset(spark, request):
    before = {key: spark.conf.get(key) for key in MODES["fused"]}
    set_mode(spark, request.param)
    yield request.param
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("parts", [1, 8])
def test_scan_expression_filter_print(spark, preset, parts):
    frame = spark.range(0, 5_000_000, 1, parts).select((F.col("id") % 500).alias("col_1"))
    step = project(scan(frame, ["col_1"]), {"project": with_constant("add", 7, F.col("col_1"))})
    step = project(step, {"keep": F.col("project") == 503}, ["project"])
    assert format_rows(filter_keep(step, F.col("keep"), ["project"])) == "project\n" + "503\n" * 10_000


@pytest.mark.parametrize("parts", [1, 8])
def test_aggregation(spark, preset, parts):
    frame = spark.range(0, 2_000_000, 1, parts).select((F.col("id") % 100_000).alias("col_1"), F.lit(7).cast("long").alias("col_2"), F.lit(3).alias("col_3"))
    out = aggregate(scan(frame, ["col_1", "col_2", "col_3"]), ["col_1"], {"a": ("sum", "col_2"), "b": ("sum", "col_3"), "n": ("count", "col_2")})
    assert [tuple(r) for r in out.groupBy("a", "b", "n").agg(F.count("*"), F.count_distinct("col_1")).collect()] == [(140, 60, 20, 100_000, 100_000)]


@pytest.mark.parametrize("parts", [1, 8])
def test_join(spark, preset, parts):
    build = spark.range(0, 500_000, 1, parts).select(F.col("id").alias("k_l"), F.lit(3).alias("p_l")).repartition(parts, F.xxhash64("k_l"))
    probe = spark.range(0, 2_000_000, 1, parts).select((F.col("id") % 1_000_000).alias("k_r"), F.lit(7).alias("p_r"), F.xxhash64("id").alias("mixed")).repartition(parts, "mixed")
    joined = equi_join(scan(build, ["k_l", "p_l"]), scan(probe, ["k_r", "p_r"]), ["k_l"], ["k_r"], unique_left=True)
    assert joined.columns == ["k_l", "p_l", "k_r", "p_r"]
    lines = as_lines(joined).groupBy("value").agg(F.count("*").alias("n"))
    key = F.substring_index("value", ",", 1)
    right = (F.col("n") == 2) & (F.col("value") == F.concat(key, F.lit(",3,"), key, F.lit(",7"))) & (key.cast("long") < 500_000)
    assert tuple(lines.agg(F.count("*"), F.count_if(right)).first()) == (500_000, 500_000)
