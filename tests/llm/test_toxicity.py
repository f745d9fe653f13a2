import random
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import toxicity as tox


@pytest.mark.parametrize(
    ("text", "kind"),
    [("You are a total idiot.", "D"), ("what an idiot", "K"), ("you are not an idiot", "n"), ("she said that he is an idiot", "r"),
     ('"you idiot" is a phrase', "r"), ("I will kill you", "X"), ("they kill time", "X"), ("kill the process. You wait", "T"), ("The idiot. You are kind", "K")],
)
def test_clauses(text, kind):
    symbols = "".join(map(tox.Lexicon({}).__getitem__, tox._TOKEN.findall(text.lower())))
    assert kind in tox.transduce(symbols)


def test_targets_weigh_by_strength():
    lexicon = tox.Lexicon({"vequ*": 6.0, "zorb": 3.5})
    assert [lexicon[w] for w in ("vequta", "zorb", "vequ", "moron", "table")] == ["I", "J", "o", "K", "o"]
    assert [tox.transduce(s) for s in ("UoI", "UoJ", "UoK", "UoT", "IooU")] == ["UoA", "UoC", "UoD", "UoX", "AooU"]


def made(n, seed):
    r = random.Random(seed)
    words = ["table", "river", "green", "walk", "stone", "cloud", "paper", "quiet", "lamp", "field"]
    rows, labels = [], []
    for i in range(n):
        text = [r.choice(words) + r.choice(["", "s", "ed", "er"]) for _ in range(r.randrange(20, 80))]
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            text.insert(r.randrange(len(text)), "grolk" + r.choice(["a", "in", "est", "um", "or"]))
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learned_words_carry_over_to_held_out_documents(spark):
    rows, labels = made(600, 2)
    docs = spark.createDataFrame([*rows, (9000, None, "x"), (9001, "", "x"), (None, "grolkin " * 9, "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (5, None), (4, 1), (4, 1)], "doc_id long, toxic int")
    learned, weights = tox.fit(docs, marks)
    assert "grolk*" in learned and not any(w in learned for w in ("table", "green"))
    scores = [(r.doc_id, r.score) for r in tox.score(docs, learned, weights).collect()]
    assert len(scores) == 604 and all(0 <= s <= 1 for _, s in scores)
    assert all((s >= 0.5) == (i % 4 == 0) for i, s in scores if i is not None and i < 600)
    assert dict(scores)[9000] == dict(scores)[9001] < 0.5 < dict(scores)[None]


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "you are a pathetic loser and a worthless clown"), (2, "a quiet day")], "doc_id long, text string")
    learned, weights = tox.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in tox.score(docs, learned, weights).collect()}
    assert got[1] > 0.5 > got[2]
    assert tox.score(docs.limit(0), learned, weights).count() == 0


def test_composed_machine_does_what_its_parts_do_in_turn():
    r = random.Random(9)
    alphabet = sorted({a for _, a in tox.CASCADE[0]})
    for _ in range(2000):
        symbols = r.choices(alphabet, k=r.randrange(0, 40))
        in_turn = symbols
        for machine in tox.CASCADE:
            in_turn = tox.run(machine, in_turn)
        assert tox.run(tox.GRAMMAR, symbols) == in_turn


def contexts(clause):
    """Kind and context of each insult or threat, by looking around it; the rules in words."""
    out = []
    for i, a in enumerate(clause):
        if a not in tox.KINDS:
            continue
        opened, since = False, []  # symbols since the last quotation mark that means something
        for k, b in enumerate(clause[:i]):
            if b == "Q":
                opened, since = (not opened and "Q" in clause[k + 1 :]), []
            else:
                since.append(b)
        tail = lambda n: since[max(0, len(since) - n) :]
        behind = next((k for k, b in enumerate(clause[i + 1 :]) if b in "QU" + tox.KINDS), None)
        close = behind is not None and behind < tox.TARGET_BEHIND and clause[i + 1 + behind] == "U"
        context = tox.AIMED if close or "U" in tail(tox.TARGET_REACH) else tox.PLAIN
        context = tox.NEGATED if "N" in tail(tox.NEGATION_REACH) else context
        context = tox.REPORTED if opened or "R" in tail(tox.SPEECH_REACH) else context
        out.append(tox.KINDS.index(a) * 4 + context)
    return out


def test_paths_against_the_rules_in_words():
    r = random.Random(10)
    for _ in range(4000):
        clause = "".join(r.choices("IJKTUNRQo", [2, 1, 1, 2, 2, 1, 1, 2, 8], k=r.randrange(0, 30)))
        assert tox.arcs_of(clause) == contexts(clause), clause


def scored(text, theta):
    by_arc, rest = tox.arc_weights(np.array(theta))
    return tox.chance([rest, *(sum(by_arc[a] for a in c) for c in tox.clauses(text, tox.Lexicon({"grolk*": 6.0})))])


@pytest.mark.parametrize("weights", ["prior", "fitted"])
def test_contexts_move_the_score(spark, weights):
    theta = tox.PRIOR
    if weights == "fitted":
        rows, labels = made(400, 3)
        theta = tox.fit(spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int"))[1]
    for word in ("moron", "grolkin"):
        plain, aimed = scored(f"what a {word} day", theta), scored(f"you are a {word}", theta)
        negated, reported = scored(f"you are not a {word}", theta), scored(f'someone wrote "you are a {word}" there', theta)
        assert scored("a quiet day", theta) < negated < plain < aimed and reported < plain
        assert scored(f"you are a {word}. you {word}", theta) > aimed  # a second clause adds to the first
    assert scored("kill the process", theta) < 0.5 < scored("I will kill you", theta)
    assert scored("I will not kill you", theta) < scored("kill the process", theta)


def test_what_the_sample_does_not_show_keeps_its_weight():
    x = np.zeros((200, tox.N_ARCS))
    x[:100, 0] = 3  # strong plain insults only
    theta = tox.fit_weights(x, np.repeat([1.0, 0.0], 100))
    assert np.allclose(theta[[2, 3, 4, 5, 6, 7]], tox.PRIOR[[2, 3, 4, 5, 6, 7]], atol=0.05) and theta[0] > tox.PRIOR[0]


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="the test tables are not here")
def test_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = tox.op4_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in found) >= 0.98 * len(found) > 500
