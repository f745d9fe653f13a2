import random

import pytest

from tessera.llm import decontaminate as dc

ITEMS = [
    (1, "A train from Lyon carries 240 passengers for 35 km before Marta leaves it; how many passengers does the train of Marta carry after 12 more km?"),
    (2, "Compute the sum of all odd numbers between the roots of the given equation and explain why the result cannot be negative in this case."),
    (3, "short item of words"),
    (4, None),
    (None, "An item without any id is still a passage that one would not want to see in a corpus of training text."),
]
FILLER = "the quiet river ran along a green field while people spoke about nothing in particular and"


def leaks(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, place string")
    return dc.find_leaks(d, b)


def test_copies_and_new_parameters(spark):
    docs = [
        (10, f"{FILLER} {ITEMS[0][1]} {FILLER}"),
        (11, FILLER + "\n" + ITEMS[0][1].replace("Lyon", "Turin").replace("240", "1,300").replace("35", "70").replace("12", "9").replace("Marta", "Ivan").replace("km", "miles")),
        (12, ITEMS[1][1].upper()),
        (13, ITEMS[1][1].replace(",", "").replace("  ", " ") + FILLER),
        (14, f"{FILLER} Short item of words. {FILLER}"),
        (15, f"{FILLER}. {ITEMS[4][1]}"),
        (16, f"{FILLER} {ITEMS[0][1]} {ITEMS[1][1]}"),
        (None, ITEMS[1][1]),
        (13, ITEMS[1][1] + FILLER),
    ]
    got = sorted(((r.doc_id, r.item_id, r.n_changed > 0) for r in leaks(spark, docs).collect()), key=str)
    expected = [(10, 1, False), (11, 1, True), (13, 2, False), (13, 2, False), (15, None, False), (16, 1, False), (16, 2, False), (None, 2, False)]
    assert [g for g in got if g[0] not in (12, 14)] == sorted(expected, key=str)


def test_slots_must_be_consistent(spark):
    # two different counterparts for one name, then one counterpart for two numbers
    one = ITEMS[0][1].replace("Marta leaves", "Ivan leaves").replace("of Marta", "of Petra")
    two = ITEMS[0][1].replace("35", "12")
    assert leaks(spark, [(1, one), (2, two)]).count() == 0


def test_clean_documents(spark):
    r = random.Random(2)
    words = ITEMS[0][1].split() + ITEMS[1][1].split() + FILLER.split() + ["5", "km", "Lyon"]
    docs = [(i, " ".join(r.choice(words) for _ in range(400))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "5 " * 5000), (103, "Lyon 5 km " * 3000), (104, " ".join(ITEMS[0][1].split()[:14])), (105, "\x01n \x01d")]
    assert leaks(spark, docs).count() == 0


@pytest.mark.parametrize("limit", [dc.BROADCAST_ROWS, 1])
def test_against_verbatim_search(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", limit)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    b = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = b.collect()
    expected = {(r.doc_id, i.item_id) for r in d.collect() for i in items if i.text in r.text}
    got = dc.find_leaks(d, b)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == expected and expected
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    left = dc.without_leaks(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in d.collect()} - {i for i, _ in expected}


def test_empty_tables(spark):
    assert leaks(spark, [(1, ITEMS[0][1])], [(1, None)]).count() == 0
    d = spark.createDataFrame([], "doc_id long, text string")
    b = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.find_leaks(d, b).count() == 0 and dc.without_leaks(d, b).count() == 0
    assert dc.find_leaks(b.withColumnRenamed("item_id", "doc_id"), d.withColumnRenamed("doc_id", "item_id")).count() == 0


def found(spark, docs, items):
    return {(r.doc_id, r.item_id) for r in leaks(spark, docs, items).collect()}


VARIANT = ITEMS[0][1].replace("240", "1,300").replace("35", "70").replace("12", "9").replace("Lyon", "Turin")


def test_each_occurrence_is_judged_by_itself(spark):
    third = ITEMS[0][1].replace("240", "77").replace("35", "41").replace("Marta", "Olga")
    stray = "after 9 more km of road"
    docs = [
        (1, f"{ITEMS[0][1]} {FILLER} {VARIANT}"),
        (2, f"{VARIANT} {third}"),
        (3, f"{FILLER} carries 90 passengers for 70 km before Petra leaves it; {FILLER} {ITEMS[0][1]} {stray}"),
        (4, VARIANT.replace("how many", f"{FILLER} {FILLER} how many")),
        (5, ITEMS[0][1].replace("Marta leaves", "Ivan leaves").replace("of Marta", "of Petra") + f" {FILLER} {FILLER}"),
    ]
    assert found(spark, docs, ITEMS[:1]) == {(1, 1), (2, 1), (3, 1), (4, 1)}


def test_two_items_of_one_template(spark):
    items = [(1, ITEMS[0][1]), (2, VARIANT)]
    got = {(r.doc_id, r.item_id): r.n_changed for r in leaks(spark, [(1, f"{items[0][1]}\n{FILLER}\n{items[1][1]}")], items).collect()}
    assert got == {(1, 1): 0, (1, 2): 0}


def test_short_items_and_items_of_few_literals(spark):
    items = [*ITEMS[1:3], (6, "Solve 3 x + 5 = 20 for x"), (7, "Anna, Bela, Carl, Dora, Emil and Fritz"), (8, "Yes")]
    docs = [
        (12, ITEMS[1][1].upper()),
        (14, f"{FILLER} Short item of words. {FILLER}"),
        (16, f"{FILLER} Solve 3 x + 5 = 20 for x. {FILLER}"),
        (17, f"{FILLER} Solve 4 x + 6 = 30 for x. {FILLER}"),
        (18, f"{FILLER} anna, Bela, Carl, Dora, Emil and Fritz {FILLER}"),
        (19, "short item of"),
        (20, f"{FILLER}: yes! {FILLER}"),
        (21, "of words short item yesterday"),
    ]
    assert found(spark, docs, items) == {(12, 2), (14, 3), (16, 6), (17, 6), (18, 7), (20, 8)}


QUESTION = "Marta has 5 apples. Marta buys 3 more apples. Marta gives 2 to Ivan. How many apples does Marta have now?"


def test_names_at_starts_and_other_case(spark):
    docs = [
        (1, FILLER + "\n" + QUESTION.replace("Marta", "Olga").replace("Ivan", "Peter").replace("5", "8")),
        (2, f"{FILLER} {QUESTION.upper()}"),
        (3, f'{FILLER} "{QUESTION.lower()}"'),
        (4, QUESTION.replace("Marta gives", "Olga gives").replace("5", "8").replace("does Marta", "does Peter")),
    ]
    got = {r.doc_id: r.n_changed > 0 for r in leaks(spark, docs, [(1, QUESTION)]).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_extra_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, QUESTION, 5, 6, 7), (2, FILLER, 5, 6, 7)], "doc_id long, text string, leaked_id long, leaked_key long, item_key long")
    items = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    assert [tuple(r) for r in dc.without_leaks(docs, items).collect()] == [(2, FILLER, 5, 6, 7)]


def test_names_and_numbers_of_several_words(spark):
    docs = [
        (1, f"{FILLER} " + ITEMS[0][1].replace("Lyon", "New York").replace("Marta", "Anna Maria")),
        (2, f"{FILLER} " + ITEMS[0][1].replace("240", "two hundred").replace("35", "seventy-one").replace("12", "nine")),
        (3, f"{FILLER}. Anna Maria has two apples." + QUESTION.replace("Marta has 5 apples.", "").replace("Marta", "Anna Maria").replace("Ivan", "Jean Paul Petit")),
        (4, f"{FILLER} " + ITEMS[0][1].replace("35 km", "two hundred miles").replace("12 more km", "ninety more miles")),
        (5, f"{FILLER} " + ITEMS[0][1].replace("Marta leaves", "Anna Maria leaves").replace("of Marta", "of Anna Petra")),
    ]
    got = {(r.doc_id, r.item_id): r.n_changed for r in leaks(spark, docs, [ITEMS[0], (2, QUESTION)]).collect()}
    assert {k for k in got} == {(1, 1), (2, 1), (3, 2), (4, 1)} and all(n >= 2 for n in got.values())
