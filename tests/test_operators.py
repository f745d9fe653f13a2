"""Operators on generated relations with known results."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import all_of, any_of, in_list, int_div, like_tokens, not_like_tokens, with_constant
from tessera.operators import aggregate, equi_join, filter_keep, limit, project, scan, top


def test_scan_order_and_missing(spark):
    frame = spark.range(1024).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    assert scan(frame, ["b", "a"]).columns == ["b", "a"]
    with pytest.raises(Exception, match="nope"):
        scan(frame, ["nope"]).collect()


def test_expression_chain(spark):
    frame = spark.range(10).select((F.col("id") + 1).alias("x"), F.col("id").alias("y"))
    step = project(frame, {"a": F.col("x") + F.col("y")}, ["x", "y"])
    step = project(step, {"b": F.col("a") - F.col("y")}, ["a"])
    step = project(step, {"c": F.col("a") * F.col("b"), "d": with_constant("add", 5, F.col("a") * F.col("b"))}, ["a", "b"])
    for k, row in enumerate(sorted(step.collect())):
        assert tuple(row) == (2 * k + 1, k + 1, (2 * k + 1) * (k + 1), (2 * k + 1) * (k + 1) + 5)


def test_filter_keeps_columns(spark):
    even = F.col("id") % 2 == 0
    frame = spark.range(10).select(F.when(even, F.col("id") + 1).otherwise(F.col("id")).alias("x"), F.when(even, F.col("id")).otherwise(F.col("id") + 1).alias("y"))
    assert sorted(map(tuple, filter_keep(frame, F.col("x") > F.col("y")).collect())) == [(2 * k + 1, 2 * k) for k in range(5)]


MEASURES = {"s": ("sum", "v"), "a": ("avg", "v"), "n": ("count",)}


@pytest.mark.parametrize("wanted", [["n"], ["s"], ["a"], ["s", "n"], ["a", "s", "n"]])
@pytest.mark.parametrize("keys", [["k"], ["k", "v"]])
def test_aggregation(spark, keys, wanted):
    frame = spark.range(20_000).select((F.col("id") % 1000).alias("k"), F.lit(42).alias("v"))
    rows = aggregate(frame, keys, {m: MEASURES[m] for m in wanted}).collect()
    assert len(rows) == 1000
    assert all(row[m] == {"s": 840, "a": 42.0, "n": 20}[m] for row in rows for m in wanted)


def test_aggregation_string_key_and_intended_sums(spark):
    words = F.element_at(F.array(*map(F.lit, ["asdf", "beta", "yoyo", "uppr"])), (F.col("id") % 4 + 1).cast("int"))
    frame = spark.range(10_000).select(words.alias("w"), F.lit(7).alias("v"))
    assert {r.w: (r.s, r.n) for r in aggregate(frame, ["w"], {"s": ("sum", "v"), "n": ("count", "v")}).collect()} == {w: (17_500, 2500) for w in ("asdf", "beta", "yoyo", "uppr")}


def test_empty_global_aggregate_is_one_row(spark):
    rows = aggregate(spark.range(0), [], {"n": ("count",), "s": ("sum", "id")}).collect()
    assert [tuple(r) for r in rows] == [(0, None)]


def test_join_one_and_two_keys(spark):
    build = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10).alias("m"))
    probe = spark.range(10_000).select((F.col("id") % 1000).alias("k"), F.lit(3).alias("m"))
    assert equi_join(build, probe, ["k"], ["k"]).count() == 10_000
    assert equi_join(build, probe, ["k", "m"], ["k", "m"]).count() == 1000


def test_left_outer_preserves_unmatched(spark):
    build = spark.range(1000).select(F.col("id").alias("k"))
    probe = spark.range(1500).select((F.col("id") % 500).alias("p"))
    rows = equi_join(build, probe, ["k"], ["p"], "left_outer").groupBy("k").agg(F.count("p").alias("n")).collect()
    assert {r.k: r.n for r in rows} == {k: 3 if k < 500 else 0 for k in range(1000)}


def test_semi_join_emits_each_row_once(spark):
    build = spark.range(10).select(F.col("id").alias("k"))
    probe = spark.range(40).select((F.col("id") % 5).alias("p"))
    assert sorted(r.k for r in equi_join(build, probe, ["k"], ["p"], "left_semi").collect()) == [0, 1, 2, 3, 4]


def test_duplicate_left_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(1,), (2,)], "p int")
    assert equi_join(left, right, ["k"], ["p"]).count() == 3
    with pytest.raises(Exception, match="not unique"):
        equi_join(left, right, ["k"], ["p"], unique_left=True).collect()
    with pytest.raises(ValueError, match="as many"):
        equi_join(left, right, ["k"], [])


def test_strings_compare_by_value(spark):
    left = spark.createDataFrame([("ab", 1), ("cd", 2)], "k string, v int")
    right = spark.createDataFrame([("a",), ("c",)], "p string").select(F.concat("p", F.when(F.col("p") == "a", "b").otherwise("d")).alias("p"))
    assert sorted(r.v for r in equi_join(left, right, ["k"], ["p"]).collect()) == [1, 2]


def test_limit_and_top(spark):
    assert limit(spark.range(100), 7).count() == 7
    assert [r.id for r in top(spark.range(100), 3, F.desc("id")).collect()] == [99, 98, 97]


def test_expression_builders(spark):
    frame = spark.createDataFrame([("a special x requests", -7), ("requests special", 7), ("50%_off", 0)], "s string, n int")
    row = frame.select(like_tokens(F.col("s"), ["special", "requests"]).alias("m"), not_like_tokens(F.col("s"), []).alias("e"), in_list(F.col("s"), []).alias("i"), like_tokens(F.col("s"), ["%_"]).alias("q"), int_div(F.col("n"), F.lit(2)).alias("d"))
    assert [tuple(r) for r in row.collect()] == [(True, False, False, False, -3), (False, False, False, False, 3), (False, False, False, True, 0)]
    assert frame.where(all_of(F.col("n") > -9, any_of(F.col("n") == 7, F.col("n") == 0))).count() == 2


def test_division_of_a_constant(spark):
    frame = spark.createDataFrame([(4,), (-8,), (None,)], "n int")
    assert [r.d for r in frame.select(with_constant("divide", 2, F.col("n")).alias("d")).collect()] == [0.5, -0.25, None]
