import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common


def test_word_table_splits_as_the_pattern_does():
    r = random.Random(2)
    texts = ["", " ", "a", "a  b\tc\n", "é\x1c ü\x85x y"] + ["".join(r.choice("ab \t\n\r\x0b\x0cé") for _ in range(r.randrange(60))) for _ in range(200)]
    data = [t.encode() for t in texts]
    table = common.WordTable(data)
    hashes = table.hashes()
    seen = {}
    for d, text in enumerate(data):
        own = range(table.first[d], table.last[d])
        assert [table.raw[table.starts[i] : table.ends[i]] for i in own] == text.split()
        for i, w in zip(own, text.split(), strict=True):
            assert seen.setdefault(w, hashes[i]) == hashes[i]
    assert len(set(seen.values())) == len(seen)
    assert common.WordTable([b"Ab \xc3\x89"], lower=True).raw == b"ab \xc3\x89"


def test_span_hash_depends_on_the_content_alone():
    values = common.mix(np.random.default_rng(1).integers(1, 5, 500).astype(np.uint64))
    prefix = common.prefix_hash(values)
    starts = np.repeat(np.arange(490), 3)
    ends = starts + np.tile([1, 4, 9], 490)
    found = {}
    for a, b, h in zip(starts, ends, common.span_hash(prefix, starts, ends), strict=True):
        assert found.setdefault(tuple(values[a:b]) , h) == h
    assert len(set(found.values())) == len(found)


def test_sub_batches_cover_all_texts_in_order():
    texts = [b"x" * n for n in (0, 5, 100, 1, 1, 1, 40, 0)]
    parts = list(common.sub_batches(texts, 10))
    assert parts[0][0] == 0 and parts[-1][1] == len(texts) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert list(common.sub_batches([], 10)) == []


def test_folds_and_samples(spark):
    docs = spark.createDataFrame([(i, f"t{i}", i) for i in range(200)] + [(None, "n", 0)], "doc_id long, text string, label long")
    folds = {r.doc_id: r.f for r in docs.select("doc_id", common.fold_of(F.col("doc_id")).alias("f")).collect()}
    assert all(f == zlib.crc32(str(i).encode()) % 5 for i, f in folds.items() if i is not None) and folds[None] == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, None), (8, 1), (None, 1)], "doc_id long, toxic int")
    rows = common.labelled_sample(docs, labels, "toxic", 50).collect()
    assert len(rows) == 50 and all(folds[r.doc_id] for r in rows)
    every = {r.doc_id: r.label for r in common.labelled_sample(docs, labels, "toxic", 1000).collect()}
    assert len(every) == sum(f > 0 for i, f in folds.items() if i is not None) and every.get(8, 1) == 1
    assert {r.doc_id for r in rows} <= set(every)


def test_small_sides(spark):
    def hinted(rows):
        return "ResolvedHint" in common.small_side(spark.range(10), rows)._jdf.queryExecution().analyzed().toString()

    assert hinted(10) and not hinted(9)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_joins_deal_hot_keys_to_many_parts(spark, monkeypatch, how):
    monkeypatch.setattr(common, "PART_ROWS", 10)
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(k, 0) for k in range(40)] + [(None, 5)] + [(2, i) for i in range(11)], "k long, x long")
    right = spark.createDataFrame([(k, k * 7) for k in range(0, 30)], "k long, y long")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = common.hot_keys(counts, "k", "n", left.count())
    assert {(r.k, r.parts) for r in hot.collect()} == {(1, 31), (2, 2)}
    # the limit follows the total, so there are few hot keys however many rows there are
    assert common.hot_keys(counts, "k", "n", 10_000 * common.MOST_HOT).count() == 0
    got = common.dealt_join(left, right, "k", hot, F.xxhash64("x"), how)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(tuple, got.select("k", "x", "y").collect()), key=key) == sorted(map(tuple, left.join(right, "k", how).select("k", "x", "y").collect()), key=key)


def test_a_cluster_must_name_a_shared_checkpoint_folder(monkeypatch):
    class Context:
        master, found = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.found

        def setCheckpointDir(self, folder):
            self.found = folder

    class Conf:
        def get(self, key, default):
            return self.folder or default

    class Session:
        sparkContext, conf = Context(), Conf()

    Session.conf.folder = None
    with pytest.raises(ValueError, match="share"):
        common.ensure_checkpoint_dir(Session)
    Session.conf.folder = "/shared"
    assert common.ensure_checkpoint_dir(Session) == "/shared"


def test_batches_are_bounded_by_bytes(spark):
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(3000).selectExpr("repeat('x', 10000) as t").coalesce(1)
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    try:
        for asked, most in (("128m", common.BATCH_BYTES), ("1m", 1 << 20), ("2048k", 2 << 20), (None, common.BATCH_BYTES)):
            spark.conf.set(bound, asked) if asked else spark.conf.unset(bound)
            found = [r.n for r in common.map_arrow(rows, sizes, "n long").collect()]
            assert sum(found) >= 3000 * 10_000 and 0.5 * most < max(found) < 1.1 * most
    finally:
        spark.conf.unset(bound)
