import datetime
import io
import random
import struct
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.cli import Runner
from tessera.operators import aggregate
from tessera.sources import COLUMN_TYPES, TABLES, checked, struct_of, format_rows, load, load_schema, missing_columns, read_delimited, write_text
from tessera.sources.sinks import count_rows
from tessera.streaming import drain, stream_table


def test_delimited_rows(spark, tmp_path):
    (tmp_path / "nation.tbl").write_text("0|ALGERIA|0|text, with comma|\n1|ARGENTINA|1|more\n")
    rows = sorted(load(spark, str(tmp_path), "nation").collect())
    assert rows[0] == (0, "ALGERIA", 0, "text, with comma") and rows[1].n_comment == "more"


def test_dates_and_numbers(spark, tmp_path):
    (tmp_path / "orders.tbl").write_text("1|2|O|1.5|1969-12-30|1-URGENT|c|0|x|\n")
    row = load(spark, str(tmp_path), "orders").select(F.unix_date("o_orderdate").alias("e"), "*").first()
    assert row.e == -2 and row.o_orderdate == datetime.date(1969, 12, 30) and row.o_totalprice == 1.5


def test_too_few_fields(spark, tmp_path):
    (tmp_path / "region.tbl").write_text("0|AFRICA\n")
    path = str(tmp_path / "region.tbl")
    assert tuple(read_delimited(spark, path, TABLES["region"]).first()) == (0, "AFRICA", None)
    with pytest.raises(Exception):  # noqa: B017
        read_delimited(spark, path, TABLES["region"], strict=True).collect()


def test_missing_table(spark, tmp_path):
    with pytest.raises(Exception):  # noqa: B017
        load(spark, str(tmp_path), "part")
    empty = load(spark, str(tmp_path), "part", force=False)
    assert empty.count() == 0 and empty.columns == TABLES["part"].names
    assert set(load_schema(spark, str(tmp_path), force=False)) == set(TABLES)
    assert missing_columns(empty.drop("p_size"), "part") == ["p_size"]


def test_text_output(spark, tmp_path):
    frame = spark.range(3).select("id", F.lit(None).cast("string").alias("nothing"), (F.col("id") * 2).alias("twice"))
    assert format_rows(frame.orderBy("id")) == "id, nothing, twice\n0,,0\n1,,2\n2,,4\n"
    assert format_rows(frame, 1).count("\n") == 2
    write_text(frame, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["0,,0", "1,,2", "2,,4"]


def test_runner(spark, tmp_path):
    (tmp_path / "lineitem.tbl").write_text("39|1|1|1|1|1|0.1|0.5|N|O|1996-01-01|1996-01-01|1996-01-01|a|b|\n")
    out = io.StringIO()
    runner = Runner(spark, out)
    for line in ("help", "run q1", f"load {tmp_path}", "mode fused", "threads 4", "show", "run l_point", "mute", "run l_count", "mode hybrid"):
        assert runner.handle(line)
    assert not runner.handle("exit")
    text = out.getvalue()
    assert "load a directory first" in text and "l_tax\n0.5\n" in text and "l_count: 1 rows" in text and "num_rows" not in text


def test_stream_matches_batch(spark, tmp_path):
    frame = spark.range(100).select("id", (F.col("id") % 7).alias("k"))
    frame.repartition(5).write.parquet(str(tmp_path / "in"))
    drain(stream_table(spark, str(tmp_path / "in"), 2).where(F.col("id") >= 10), str(tmp_path / "out"), str(tmp_path / "mark"))
    got = aggregate(spark.read.parquet(str(tmp_path / "out")), ["k"], {"n": ("count",)})
    assert sorted(got.collect()) == sorted(aggregate(frame.where(F.col("id") >= 10), ["k"], {"n": ("count",)}).collect())


def test_declared_types(spark):
    assert [f.dataType.simpleString() for f in struct_of({"a": "UI2", "b": "UI8", "c": "Date"}).fields] == ["int", "decimal(20,0)", "date"]
    frame = spark.createDataFrame([("0",), ("255",), (None,)], "v string")
    for kind in ("I2", "I4", "I8", "UI1", "UI2", "UI4", "UI8", "F4", "F8"):
        rows = frame.select(checked(F.col("v"), kind).alias("v"))
        assert rows.schema["v"].dataType == COLUMN_TYPES[kind] and [None if r.v is None else int(r.v) for r in rows.collect()] == [0, 255, None]
    for value, kind in (("256", "UI1"), ("-1", "UI4"), ("18446744073709551616", "UI8"), ("ab", "Char")):
        with pytest.raises(Exception):  # noqa: B017
            spark.createDataFrame([(value,)], "v string").select(checked(F.col("v"), kind)).collect()


@pytest.mark.parametrize("row", ["0|AFRICA", "0|AFRICA|", "0", "", "x|AFRICA|c|", "|AFRICA|c|", "1.5|AFRICA|c|", "99999999999|AFRICA|c|"])
def test_malformed_rows_fail_unless_tolerated(spark, tmp_path, row):
    (tmp_path / "region.tbl").write_text(f"1|ASIA||\n{row}\n")
    with pytest.raises(Exception, match="too few fields|r_regionkey is no int"):
        load(spark, str(tmp_path), "region").collect()
    assert load(spark, str(tmp_path), "region", strict=False).where("r_regionkey = 1").count() == 1


def test_well_formed_rows(spark, tmp_path):
    (tmp_path / "region.tbl").write_text("0|AFRICA||\n1||c|more|fields\n 2 |EUROPE|no end")
    assert sorted(map(tuple, load(spark, str(tmp_path), "region").collect())) == [(0, "AFRICA", ""), (1, "", "c"), (2, "EUROPE", "no end")]


def test_values_of_every_type(spark, tmp_path):
    r = random.Random(42)
    ranges = {f"I{n}": (-(256**n) // 2, 256**n // 2 - 1) for n in (1, 2, 4, 8)} | {f"UI{n}": (0, 256**n - 1) for n in (1, 2, 4, 8)}
    columns = {kind: [r.randint(*bounds) for _ in range(1000)] for kind, bounds in ranges.items()}
    columns |= {"F4": [struct.unpack("f", struct.pack("f", r.random()))[0] for _ in range(1000)], "F8": [r.random() for _ in range(1000)]}
    (tmp_path / "t.tbl").write_text("".join("|".join([str(i), *map(repr, row)]) + "|\n" for i, row in enumerate(zip(*columns.values(), strict=True))))
    frame = read_delimited(spark, str(tmp_path / "t.tbl"), struct_of({"n": "I8"} | {k: k for k in columns}), strict=True)
    rows = frame.select("n", *[checked(F.col(k), k).alias(k) for k in columns]).orderBy("n").collect()
    assert all([row[k] for row in rows] == values for k, values in columns.items())


def test_characters_dates_and_texts(spark, tmp_path):
    letters = [chr(c) for c in range(256) if chr(c) not in "|\n"]
    (tmp_path / "c.tbl").write_text("".join(f"{ord(c)}|{c}|\n" for c in letters), encoding="utf-8", newline="")
    frame = read_delimited(spark, str(tmp_path / "c.tbl"), struct_of({"n": "I4", "c": "Char"}), strict=True)
    assert {r.n: r.c for r in frame.select("n", checked(F.col("c"), "Char").alias("c")).collect()} == {ord(c): c for c in letters}
    days = {"1970-1-1": 0, "1971-1-1": 365, "1969-12-30": -2, "1970-2-2": 32}
    (tmp_path / "d.tbl").write_text("".join(f"{d}|{n}|\n" for d, n in days.items()))
    dates = read_delimited(spark, str(tmp_path / "d.tbl"), struct_of({"d": "Date", "n": "I4"}), strict=True)
    assert all(r.e == r.n for r in dates.select(F.unix_date("d").alias("e"), "n").collect())
    texts = ["Hello, world", "What's going on?", "Final String\n\n", "\n\n\n"]
    assert [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(checked(F.col("t"), "String").alias("t")).collect()] == texts


def test_counting_sink(spark):
    assert count_rows(spark.range(1000).where("id % 3 = 0")) == 334 and count_rows(spark.range(0)) == 0


def test_runner_reports_failures_and_runs_in_a_mode(spark, tmp_path):
    (tmp_path / "lineitem.tbl").write_text("39|1|1|1|1|1|0.1|0.5|N|O|1996-01-01|1996-01-01|1996-01-01|a|b|\n39|bad\n")
    out = io.StringIO()
    runner = Runner(spark, out)
    before = spark.conf.get("spark.sql.codegen.wholeStage")
    for line in (f"load {tmp_path}", "show", "run l_point", "threads none", "run l_point mode nothing"):
        assert runner.handle(line)
    (tmp_path / "lineitem.tbl").write_text("39|1|1|1|1|1|0.1|0.5|N|O|1996-01-01|1996-01-01|1996-01-01|a|b|\n")
    assert runner.handle("run l_point mode interpreted") and spark.conf.get("spark.sql.codegen.wholeStage") == before
    text = out.getvalue()
    assert text.count("failed: ") == 2 and f"loaded: {tmp_path}" in text and "help | load" in text and text.endswith(" s\n") and "l_tax\n0.5\n" in text


def test_threads_are_cores_of_a_local_session(monkeypatch):
    made, stopped = [], []
    monkeypatch.setattr(session, "build_session", lambda *a: made.append(a) or "new")
    context = SimpleNamespace(master="local[4]", appName="a", defaultParallelism=4, getConf=lambda: SimpleNamespace(getAll=lambda: [("spark.master", "local[4]"), ("spark.x", "y")]))
    old = SimpleNamespace(sparkContext=context, stop=lambda: stopped.append(1))
    assert session.with_threads(old, 4) is old and not stopped
    assert session.with_threads(old, 2) == "new" and made == [("local[2]", "a", 2, {"spark.x": "y"})] and stopped == [1]
    with pytest.raises(ValueError, match="one thread"):
        session.with_threads(old, 0)
    settings = {}
    far = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://h:1"), conf=SimpleNamespace(set=settings.__setitem__))
    assert session.with_threads(far, 16) is far and settings == {"spark.sql.shuffle.partitions": "16"}
