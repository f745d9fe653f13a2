import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_dedup as sd


def brute(rows, window):
    counts = Counter()
    for _, t in rows:
        b = (t or "").encode()
        counts.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - window + 1):
            if counts[b[k : k + window]] > 1:
                gone[k : k + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def made(seed, window):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passages = [word(window * k // 4) for k in (3, 4, 5, 9, 30)]
    rows = [(900, None), (901, ""), (902, "a" * window * 8), (903, "ab" * window * 3), (904, "ba" * window), (None, passages[4]), (905, passages[3] + passages[3]), (906, "short"), (906, "short")]
    for i in range(80):
        text = ""
        for _ in range(r.randrange(1, 5)):
            p = r.choice(passages)
            a = r.randrange(0, len(p))
            text += word(r.randrange(0, 2 * window)) + p[a : a + r.randrange(window // 2, 3 * window)]
        rows.append((r.choice([i, None]), text))
    return rows + rows[20:26]


@pytest.mark.parametrize(("seed", "window", "gram", "hot"), [(1, 40, 8, 1024), (2, 40, 8, 2), (3, 60, 16, 6), (4, 400, 64, 1024)])
def test_same_as_brute_force(spark, seed, window, gram, hot):
    rows = made(seed, window)
    docs = spark.createDataFrame([(*x, 3, "x") for x in rows], "doc_id long, text string, g int, kept string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_repeated_bytes(docs, window, gram, hot).collect()), key=str)
    assert got == brute(rows, window)
    assert sum(x[2] > 0 for x in got) > 20


def test_least_of_neighbours():
    values = np.random.default_rng(1).integers(0, 1000, 97).astype(np.uint64)
    for width in (1, 2, 5, 96, 97):
        assert sd.sliding_least(values, width).tolist() == [values[i : i + width].min() for i in range(97 - width + 1)]
    assert not len(sd.sliding_least(values, 98))


def test_empty_table_and_one_shuffle_of_texts(spark):
    docs = spark.createDataFrame(made(5, 40), "doc_id long, text string")
    assert sd.remove_repeated_bytes(docs.limit(0)).count() == 0
    out = sd.remove_repeated_bytes(docs, 40, 8)
    out.collect()
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("ReusedExchange") == 2
