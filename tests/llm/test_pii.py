import random
import re

import pytest

from tessera.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 if int(d) > 4 else 2 * int(d)) for i, d in enumerate(reversed(digits))) if digits else 1
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and total % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return pii.in_order(out)


def test_base_against_plain_patterns():
    r = random.Random(1)
    known = ["a.b@c.de", "x@y", "@", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (348) 555-9642", "+", "é", "0001.002.3.255", "a@b@c.com.", "5500000000000004 12"]
    for _ in range(4000):
        text = "".join(r.choice([r.choice(known), r.choice("0123456789 .-+()@ab\né")]) for _ in range(r.randrange(25)))
        assert pii.detect(text) == brute(text), text


def test_linear_on_long_runs():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" + "(" * 200_000, "+1" * 100_000, "a@b." * 50_000 + "@", "one " * 50_000, "[at]" * 50_000, " dot" * 50_000, "а" * 100_000):
        pii.find_all(text)


@pytest.mark.parametrize(
    ("text", "kind", "piece"),
    [
        ("write to jane.doe [at] example [dot] com now", "email", "jane.doe [at] example [dot] com"),
        ("write to jane(at)example(dot)co(dot)uk now", "email", "jane(at)example(dot)co(dot)uk"),
        ("write to jane at example dot com now", "email", "jane at example dot com"),
        ("write to jane@example dot com now", "email", "jane@example dot com"),
        ("é mail jаne@exаmple.com ok", "email", "jаne@exаmple.com"),
        ("call plus one five five five one two three four five six seven today", "phone", "plus one five five five one two three four five six seven"),
        ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
        ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
        ("host 192 dot 168 dot 1 dot 17 up", "ip", "192 dot 168 dot 1 dot 17"),
        ("call +1 three four eight five five five 9642 now", "phone", "+1 three four eight five five five 9642"),
        ("call +1 (348) 555-96O2 now", "phone", "+1 (348) 555-96O2"),
        ("card 4l11 1111 1111 1I11 ok", "card", "4l11 1111 1111 1I11"),
        ("call plus one, three, four, eight, five, five, five, nine, six, four, two", "phone", "plus one, three, four, eight, five, five, five, nine, six, four, two"),
        ("write JANE AT EXAMPLE DOT COM", "email", "JANE AT EXAMPLE DOT COM"),
        ("full ４１１１ １１１１ １１１１ １１１１ width", "card", "４１１１ １１１１ １１１１ １１１１"),
    ],
)
def test_disguises_map_back(text, kind, piece):
    _, spans = pii.find_all(text)
    assert (text.index(piece), text.index(piece) + len(piece), kind) in spans


@pytest.mark.parametrize("text", ["Look at the dot com boom at one point.", "We met at noon. One two three go!", "the at of in dot", "one or two at six", "seven eight nine ten people [at] home", "Ελλάδα και Россия", "(at) (dot)"])
def test_clean_text_stays_clean(text):
    assert pii.find_all(text) == ([], [])


def test_letters_that_only_look_alike_in_the_other_case_are_copied():
    letters = [chr(c) for c in (0xB5, 0x212A, *range(0x370, 0x530), *range(0x1F00, 0x2000), *range(0xFF01, 0xFF5F))]
    for text in (*(f"о {c}" for c in letters), "".join(letters), "в Москве кто-то ответил: всё так, Ωμέγα και βήτα"):
        assert pii.Written(text).text == "".join(pii.LOOKALIKES.get(c, c) for c in text)
        pii.find_all(text)


def test_documents(spark):
    rows = [(1, "mail a@b.co and +1 (348) 555-9642", "s"), (2, None, "s"), (3, "", None), (None, "x (at) y (dot) com", "s"), (1, "mail a@b.co and +1 (348) 555-9642", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs)).collect()}
    assert got[1].spans == "email:5:11,phone:16:33" and (got[1].n_email, got[1].n_phone, got[1].n_ip) == (1, 1, 0)
    assert got[1].base_sha256 == pii.base_sha256(rows[0][1]) and got[2].base_sha256 == pii.base_sha256("")
    assert got[None].n_added == 1 and got[None].n_email == 0
    assert sorted(str(r.text) for r in pii.redact(docs).collect()) == ["", "<EMAIL>", "None", "mail <EMAIL> and <PHONE>", "mail <EMAIL> and <PHONE>"]
    assert pii.digest(pii.find_pii(docs.limit(0))).count() == 0


def test_long_words_before_a_spelled_dot():
    name = "a.very-long.local_part" * 20
    text = f"write to {name}@host dot com today"
    assert (9, len(text) - 6, "email") in pii.find_all(text)[1]
