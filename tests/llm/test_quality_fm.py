import random

import numpy as np

from tessera.llm import quality_fm as fm


def test_sum_of_squares_identity():
    r = np.random.default_rng(4)
    m = fm.Machine(np.zeros(fm.N_STATS), np.ones(fm.N_STATS), 0.3, r.normal(size=fm.N_STATS + fm.BUCKETS), r.normal(size=(fm.N_STATS + fm.BUCKETS, 3)))
    x = np.zeros((1, fm.N_STATS + fm.BUCKETS))
    used = r.choice(x.shape[1], 12, replace=False)
    x[0, used] = r.normal(size=12)
    pairs = sum(m.factors[i] @ m.factors[j] * x[0, i] * x[0, j] for a, i in enumerate(used) for j in used[a + 1 :])
    assert np.isclose(m.margin(x)[0], 0.3 + x[0] @ m.linear + pairs)


def test_measures_do_not_depend_on_the_batch():
    texts = [b"", b"one two  two\nthree", b"  \n ", "é |x| !! Z".encode(), b"a " * 5000]
    together = fm.measure(texts, np.full(len(texts), np.nan))
    for i, t in enumerate(texts):
        alone = fm.measure([t], np.array([np.nan]))
        assert np.allclose(together[0][i], alone[0][0]) and np.allclose(together[1][i], alone[1][0])
    assert together[1][0].sum() == 0 and np.isclose((together[1][1] ** 2).sum(), 1)


def made(n):
    r = random.Random(8)
    words = ["table", "river", "green", "walk", "stone", "cloud", "paper", "quiet"]
    for i in range(n):
        text = " ".join(r.choice(words) + r.choice(["", "s", "ed"]) for _ in range(r.randrange(20, 90)))
        bad = i % 5 == 0
        yield i, (text.upper().replace(" ", " $$# ") if i % 2 else " ".join([text.split()[0]] * 40)) if bad else text, int(not bad)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = list(made(700))
    docs = spark.createDataFrame([*[(i, t, len(t), "x") for i, t, _ in rows], (9000, None, None, "x"), (9001, "", 0, "x"), (None, rows[1][1], 3, None), (1, rows[1][1], 5, "x")], "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([*[(i, q) for i, _, q in rows], (3, None), (4, 1)], "doc_id long, quality int")
    machine = fm.fit(docs, labels)
    got = [(r.doc_id, r.score) for r in fm.score(docs, machine).collect()]
    assert len(got) == 704 and all(0 <= s <= 1 for _, s in got)
    truth = {i: q for i, _, q in rows}
    right = [(s >= 0.5) == bool(truth[i]) for i, s in got if i in truth]
    assert sum(right) / len(right) > 0.98
    assert fm.score(docs.limit(0), machine).count() == 0
    assert fm.score(docs.drop("n_chars"), machine).count() == 704


def test_one_kind_of_label(spark):
    docs = spark.createDataFrame([(i, "some text", 9) for i in range(20)], "doc_id long, text string, n_chars long")
    only = fm.fit(docs, spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int"))
    assert min(r.score for r in fm.score(docs, only).collect()) > 0.8
    none = fm.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {round(r.score, 3) for r in fm.score(docs, none).collect()} == {0.5}
