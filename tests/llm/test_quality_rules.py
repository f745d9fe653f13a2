import random
import re

import duckdb

from tessera.llm import quality_rules as qr

WORD = r"[^\x20\x09-\x0D]+"


def brute(rows):
    """doc_id -> counts and verdict, by plain loops."""
    texts, lines_of = {}, {}
    for i, text, source in rows:
        texts.setdefault((source, text or ""), []).append(i)
    for (host, text), ids in texts.items():
        first = min((i for i in ids if i is not None), default=None)
        for raw in text.split("\n"):
            if re.search(WORD, raw):
                lines_of.setdefault((host, re.sub(r"[\x20\x09-\x0D]+", " ", raw).strip(" ").lower()), {})[text] = first
    out = []
    for i, text, host in rows:
        text = text or ""
        words = re.findall(WORD, text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
        lines = [x for x in text.split("\n") if re.search(WORD, x)]
        removed = 0
        for raw in lines:
            found = lines_of[host, re.sub(r"[\x20\x09-\x0D]+", " ", raw).strip(" ").lower()]
            firsts = [f for f in found.values() if f is not None]
            mine = min((k for k in texts[host, text] if k is not None), default=None)
            if len(found) > qr.MIN_TEXTS and (mine is None or mine != min(firsts, default=None)):
                removed += len(raw)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        kept = not failed and not removed > qr.DEPLETED * sum(map(len, lines))
        out.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, kept))
    return sorted(out, key=str)


def made():
    r = random.Random(6)
    words = ["one", "two", "three", "é", "four", "#five", "six", "<b>", "Seven", "eight", "nine|", "ten", "dix", "elf"]
    common = ["Share this page with all of your good friends now", "all rights reserved by the owner of this page here"]
    rows = [(900, None, "a"), (901, "", None), (902, " \n\t\n ", "a"), (903, "x " * 3000, "a"), (904, "y" * 9000, None), (None, " ".join(words) + "\n" + common[0], "b")]
    for i in range(140):
        own = "\n".join(" ".join(r.choice(words) for _ in range(r.randrange(1, 14))) for _ in range(r.randrange(1, 5)))
        kind = i % 3
        rows.append((i, {0: own, 1: own + "\n " + common[0].upper() + "  \n" + common[1], 2: "\n".join(common) + f"\nshort {i}"}[kind], r.choice("ab")))
    return [*rows, *rows[20:40], *[(i + 500, t, s) for i, t, s in rows[30:80]]]


def test_same_as_brute_force(spark):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as host", "2 as line", "3 as salt")
    got = sorted((tuple(r) for r in qr.judge(docs).drop("removed_chars").collect()), key=str)
    assert got == brute(rows)
    assert any(not k[7] and not k[6] for k in got) and any(k[7] for k in got)


def test_sql_of_distinct_ids(spark):
    rows = list({r[0]: r for r in made() if r[0] is not None}.values())
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    frame = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    got = sorted(map(tuple, qr.judge(docs).drop("removed_chars").collect()))
    assert got == sorted(con.execute(qr.OP7_SQL).fetchall())


def test_empty_table_and_native_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    out = qr.judge(docs)
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_numbers_of_lines_beyond_the_limit_only_matter_within_a_host(spark):
    rows = [(i, f"the very same line of text in each of these\nown {i} word", str(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r.kept for r in qr.judge(docs).collect())


def test_kept_texts_lose_their_frequent_lines(spark):
    common = "Share this page with all of your good friends now"
    own = lambda i: f"own{i} line of quite a few words that stand nowhere else but here {i * 7}\n\n  and one more of them, number {i}"
    rows = [(i, f"{own(i)}\n  {common.upper()} \nlast {i}" if i % 3 else own(i), "a", 5) for i in range(60)]
    rows += [(100, f"{own(100)}\n{common}", "b", 5), (2, rows[2][1], "a", 5), (101, common + " and ten words in all", "b", 5), (102, None, "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lost long")
    kept = qr.kept_documents(docs)
    assert kept.columns == docs.columns and "Python" not in kept._jdf.queryExecution().executedPlan().toString()
    # the line stays in the first text that has it, in texts without it, and in another source
    expected = [(i, t.replace(f"\n  {common.upper()} ", "") if s == "a" and i != 1 else t, s, n) for i, t, s, n in rows if t is not None]
    assert sorted(map(tuple, kept.collect())) == sorted(expected)
    removed = {r.doc_id: r.removed_chars for r in qr.judge(docs).collect()}
    assert all(removed[i] == (len(f"  {common} ") if i < 60 and i % 3 and i != 1 else 0) for i in removed)


def test_hot_lines_and_texts_are_dealt_to_many_tasks_with_the_same_rows(spark, monkeypatch):
    from tessera.llm import common

    line = "a line that each of these texts has at its end"
    rows = [(i, f"own {i} line of ten words or more than that, number {i * 7}\n{line}", "a") for i in range(80)]
    rows += [(i if i % 5 else None, f"one text of very many copies and of ten words at least\n{line}", "a") for i in range(100, 250)]
    rows += [(i, "another text of very many copies which loses no line, of ten words at least", None) for i in range(300, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda r: tuple(repr(v) for v in r)
    plain = [sorted(map(tuple, f(docs).collect()), key=key) for f in (qr.judge, qr.kept_documents)]
    monkeypatch.setattr(common, "PART_ROWS", 10)
    monkeypatch.setattr(qr, "BROADCAST_LINES", -1)
    assert plain == [sorted(map(tuple, f(docs).collect()), key=key) for f in (qr.judge, qr.kept_documents)]
    assert len(plain[0]) == len(rows) and any(x[1].endswith(line) for x in plain[1]) and not all(line in x[1] for x in plain[1] if x[2] == "a")


def test_the_limit_does_not_loosen_as_a_host_grows(spark):
    line = "the very same line of text stands in a small share of these texts only"
    rows = [(i, (f"{line}\n" if i % 20 == 0 else "") + f"own {i} words of this one text, ten or more of them, number {i * 3}", "big") for i in range(600)]
    removed = {r.doc_id: r.removed_chars for r in qr.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i for i, n in removed.items() if n} == set(range(20, 600, 20))


def test_window_hashes_are_told_apart_in_a_long_text(spark):
    r = random.Random(4)
    words = [f"{r.getrandbits(40):x}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, *words[100:107]]))]
    got = {x.doc_id: x.n_repeat_words for x in qr.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 14}
