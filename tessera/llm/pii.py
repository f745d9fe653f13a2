"""Operator 3: personal data, also where it is disguised, with spans in code points of the source text.

Two layers. The base layer finds e-mail addresses, IPv4 addresses, card numbers and phone numbers as they stand. The second
layer runs a transducer that rewrites disguises (look-alike letters and digits, spelled digits, ``(at)`` and ``dot``) and keeps,
for every character that it writes, the source characters that it stands for; the same detectors run over what it wrote, and
their spans are mapped back. A span of the second layer is added unless it is one of the base layer already.

All detectors take time linear in the text. Null text is empty and has no spans; repeated rows give repeated rows; other
columns are ignored, whatever their names. ``redact`` replaces overlapping spans as one, under the name of the first.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, read_table, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# --- detectors ---

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits that cannot begin a match cannot do so from within either, so only its first digit is tried.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a local part is the whole run before its ``@`` that the match before has left."""
    at = text.find("@")
    done = 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_LETTERS:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (g.lstrip("0") for g in m.groups())):
            yield m.span()


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


_DETECTORS: dict[str, tuple[str, Callable[[str], Iterator[tuple[int, int]]]]] = {
    "email": ("@", emails), "ip": (".", ips), "card": ("", cards), "phone": ("+", phones),
}


def in_order(spans: list[Span]) -> list[Span]:
    """By start, then kind as listed, then end."""
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def detect(text: str) -> list[Span]:
    """All base spans (start, end, kind), in order."""
    found = [(a, b, kind) for kind, (sign, find) in _DETECTORS.items() if sign in text for a, b in find(text)]
    return in_order(found)


# --- the normalising transducer ---

#: Letters that look like ASCII ones (fixed values from the public Unicode confusables: Cyrillic, then Greek); full-width forms follow a rule.
LOOKALIKES = dict(zip("аесорхуіјѕԁԛԝһАВЕКМНОРСТХУІЈЅοανικρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aecopxyijsdqwhABEKMHOPCTXYIJSoavikptuxABEZHIKMNOPTYX", strict=True))
LOOKALIKES |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
#: Zero-width characters, soft hyphen: written as nothing.
INVISIBLE = "​‌‍⁠­﻿"

#: Names of the digits 0 to 9, by language (fixed values).
DIGIT_NAMES = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DIGIT_OF = {name: str(i) for names in DIGIT_NAMES for i, name in enumerate(names.split())} | {"oh": "0"}
_NAME = "(?:" + "|".join(sorted(_DIGIT_OF, key=len, reverse=True)) + ")"
_AT, _DOT = r"(?:at|arroba|arobase)", r"(?:dot|punto|punkt|point)"
#: Words that begin a noun phrase, not a domain.
_ARTICLE = r"(?:the|an?|this|that|my|our|your|his|her|its|their|some|one|el|la|le|les|los|las)"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"

#: One disguise each. Ignoring case makes ``mixed`` match o, i and L too, which stay as they are. A spelled ``at`` without brackets counts only where a spelled ``dot`` follows the next word, and a spelled ``dot`` only in an address, or between digits or their names.
_DISGUISE = re.compile(
    rf"(?P<digits>\b(?:plus )?{_NAME}(?:(?:[ ,-]{{1,2}}| {_DOT} ){_NAME}){{3,}}\b)"
    rf"|(?P<mixed>(?<![A-Za-z0-9])(?:[OIl]+[0-9]|[0-9]+[OIl])[0-9OIl]*(?![A-Za-z0-9]))"
    rf"|(?P<at>\s?{_OPEN}\s?(?:{_AT}|@)\s?{_CLOSE}\s?)"
    rf"|(?P<dot>\s?{_OPEN}\s?(?:{_DOT}|\.)\s?{_CLOSE}\s?)"
    rf"|(?P<plain>\b {_AT} (?!{_ARTICLE} )(?=[a-z0-9-]+ {_DOT} [a-z])[a-z0-9-]+(?: {_DOT} [a-z0-9-]+)+)"
    rf"|(?P<after>(?<=[a-z0-9]) {_DOT} (?=[a-z0-9-]+\b))"
    rf"|(?P<look>(?-i:[{re.escape(''.join(LOOKALIKES))}]))"
    rf"|(?P<none>[{INVISIBLE}])",
    re.IGNORECASE,
)
#: Letters that stand for digits among digits.
_DIGIT_LIKE = {"O": "0", "I": "1", "l": "1"}
_MIXED = re.compile(r"[0-9][OIl]|[OIl][0-9]")
_DIGIT_PART = re.compile(rf" {_DOT} |{_NAME}|plus |[ ,-]", re.IGNORECASE)
_PLAIN_PART = re.compile(rf" {_AT} | {_DOT} ", re.IGNORECASE)
_IS_AT = re.compile(_AT, re.IGNORECASE)
_LOOK = re.compile(rf"[{re.escape(''.join(LOOKALIKES))}{INVISIBLE}]")
_BRACKET = re.compile(rf"{_OPEN}\s?(?:{_AT}|{_DOT}|@|\.)\s?{_CLOSE}")
_SPELLED_DOTS = (" dot ", " punto ", " punkt ", " point ")


def rewritable(text: str) -> bool:
    """Whether the transducer can rewrite anything at all; much cheaper than running it."""
    if not text.isascii() and _LOOK.search(text):
        return True
    if _MIXED.search(text):
        return True
    low = text.lower()
    if any(d in low for d in _SPELLED_DOTS) or _BRACKET.search(low):
        return True
    return b"\1\1\1" in bytes(map(_DIGIT_OF.__contains__, low.replace("-", " ").replace(",", " ").split()))


class Written:
    """Normalised text with, for each written piece, the source characters that it stands for."""

    def __init__(self, source: str) -> None:
        self.pieces: list[str] = []
        self.at: list[int] = []  # where each piece begins in the normalised text
        self.of: list[tuple[int, int, bool]] = []  # source start and end; whether it is a copy, character by character
        self.size = 0
        copied, mailed = 0, -1
        for m in _DISGUISE.finditer(source):
            kind = m.lastgroup
            if kind == "after" and mailed != m.start() and not self._continues(source, m.start(), m.end()):
                continue
            self._put(source[copied : m.start()], copied, m.start(), True)
            if kind == "look":
                self._put(LOOKALIKES[m[0]], m.start(), m.end(), False)
            elif kind == "mixed":
                for i, c in enumerate(m[0], m.start()):
                    self._put(_DIGIT_LIKE.get(c, c), i, i + 1, False)
            elif kind in ("at", "dot", "after"):
                self._put("@" if kind == "at" else ".", m.start(), m.end(), False)
            elif kind in ("digits", "plain"):
                done = m.start()
                for part in (_DIGIT_PART if kind == "digits" else _PLAIN_PART).finditer(source, m.start(), m.end()):
                    self._put(source[done : part.start()], done, part.start(), True)
                    self._put(self._part(part[0].lower()), part.start(), part.end(), False)
                    done = part.end()
                self._put(source[done : m.end()], done, m.end(), True)
                mailed = m.end()
            copied = m.end()
        self._put(source[copied:], copied, len(source), True)
        self.text = "".join(self.pieces)

    @staticmethod
    def _continues(source: str, start: int, end: int) -> bool:
        """Whether a spelled dot stands in an address: behind a word with an ``@``, or between digits."""
        before = source[source.rfind(" ", 0, start) + 1 : start]
        return "@" in before or (before[-1:].isdigit() and source[end : end + 1].isdigit())

    @staticmethod
    def _part(part: str) -> str:
        if part in _DIGIT_OF:
            return _DIGIT_OF[part]
        if part == "plus ":
            return "+"
        if part in (" ", ",", "-"):
            return ""
        return "@" if _IS_AT.fullmatch(part.strip()) else "."

    def _put(self, piece: str, start: int, end: int, copy: bool) -> None:
        if piece:
            self.pieces.append(piece)
            self.at.append(self.size)
            self.of.append((start, end, copy))
            self.size += len(piece)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Source characters that a normalised span stands for."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a, _, copy = self.of[i]
        begin = a + start - self.at[i] if copy else a
        a, b, copy = self.of[j]
        return begin, a + end - self.at[j] if copy else b


def find_all(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the spans of disguised identifiers added."""
    base = detect(text)
    if not rewritable(text):
        return base, base
    written = Written(text)
    known = set(base)
    added = {(*written.back(a, b), kind) for a, b, kind in detect(written.text)} - known
    return base, in_order([*base, *added]) if added else base


def redact_text(text: str, spans: list[Span]) -> str:
    """Each group of overlapping spans becomes ``<KIND>`` of its first span."""
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


# --- DataFrame operators ---

SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, spans (kind, start, end, whether of the base layer): one row per document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts_of(batch.column(1)):
                base, every = find_all(text)
                known = set(base)
                rows.append([{"kind": k, "start": a, "end": b, "base": (a, b, k) in known} for a, b, k in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS_ARROW)], ["doc_id", "spans"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with the text redacted; null stays null."""
    names = docs.columns
    place = names.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                texts = [t and redact_text(t, find_all(t)[1]) for t in batch.column(place).to_pylist()]
                columns = [pa.array(texts, batch.schema.field(i).type) if i == place else batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_arrow(docs, work, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from spans. ``n_*`` count base spans; ``n_added`` counts what normalisation found besides."""
    base = F.filter("spans", lambda s: s["base"])

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``documents``."""
    return digest(find_pii(read_table(spark, sf_dir, "documents")))


def base_sha256(text: str) -> str:
    """Digest of a text's base spans, as in the contract."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in detect(text)).encode()).hexdigest()
