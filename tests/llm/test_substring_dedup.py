import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import groups
from tessera.llm import substring_dedup as sd


def brute(rows):
    first = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, _), words in zip(rows, split, strict=True):
        for k in range(len(words) - 49 if i is not None else 0):
            key = tuple(words[k : k + 50])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), words in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(words) - 49 if i is not None else 0):
            if first[tuple(words[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randrange(1, 4)))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 74, 130, 400)]
    rows = [(900, None), (901, ""), (902, " \n\t "), (903, "same " * 700), (904, "same " * 300 + "end"), (None, " ".join(passages[4])), (905, " ".join(passages[5])), (905, " ".join(passages[5]))]
    for i in range(120):
        words = []
        for _ in range(r.randrange(1, 6)):
            words += [word() for _ in range(r.randrange(0, 40))]
            p = r.choice(passages)
            a = r.randrange(0, max(1, len(p) - 49))
            words += p[a : a + r.randrange(40, 140)]
        rows.append((r.choice([i, 120 - i, 7]), r.choice([" ", "  ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(*x, 1, "x") for x in rows], "doc_id long, text string, g int, kept string")
    found = sd.remove_repeats(docs)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found.collect()), key=str)
    assert got == brute(rows)
    assert sum(x[2] > 0 for x in got) > 20


@pytest.mark.parametrize(("index_bytes", "candidate_bytes"), [(1 << 30, 100), (2000, 1 << 30), (500, 300)])
def test_any_number_of_buckets_gives_the_same_rows(spark, index_bytes, candidate_bytes):
    rows = made(4)
    found = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), index_bytes, candidate_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in found), key=str) == brute(rows)


def test_hits_are_extended_to_maximal_repeats(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    one, two = [word() for _ in range(90)], [word() for _ in range(61)]
    rows = [(1, " ".join([*one, *two])), (2, " ".join([word(), *one, word(), *two[:50], word()])), (3, " ".join([*[word() for _ in range(7)], *one[20:70], *two])), (4, " ".join(one[:49]))]
    got = {x.doc_id: [tuple(s) for s in x.repeats] for x in sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(1, 90), (92, 50)], 3: [(7, 50), (57, 61)], 4: []}


def test_empty_and_short(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in sd.remove_repeats(docs).collect()] == [(1, 3, 0, "a b c", [])]
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame(made(3), "doc_id long, text string")
    out = sd.remove_repeats(docs)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 2  # each of their lines repeats the exchange that it reuses
    assert len(re.findall(r"hashpartitioning\(g#\d+, 4\), REPARTITION_BY_NUM", plan)) == 3


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_packing(kind):
    values = np.unique(np.random.default_rng(1).integers(0, np.iinfo(kind).max, 1000, dtype=kind))
    assert (groups.unpack(groups.pack(values), kind) == values).all()
    assert (groups.unpack_plain(groups.pack_plain(values[::-1].copy()), kind) == values[::-1]).all()
    assert len(groups.unpack(groups.pack(values[:0]), kind)) == 0
