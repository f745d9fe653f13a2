"""Operator 2: benchmark items in documents, also with other numbers, names and units. DataFrame functions only.

Both sides are canonicalised alike: a capitalised word inside a sentence becomes a name, a number in digits or spelled a number and a unit
behind a number a unit placeholder, and neighbouring names or numbers become one ("New York", "two hundred"); the rest is lower case
without punctuation. A second template has names at the starts of sentences, lines and quotations too. Windows of ``WINDOW`` tokens
with at least ``LITERALS`` tokens that are no placeholders are hashed, and besides all windows of the folded words (lower case without
punctuation, nothing replaced), for copies in another case and items of few literals; documents' windows meet the items' windows in a
hash join. Each of the three forms is judged by itself; the folded form compares no fillers, the second template is left out for items
of which less than half of its windows have so many literals. Hits of one document and item are gathered by
their offset (windows in a row have one offset), offsets with too few hits are left out, offsets close to each other are one occurrence,
and an item is found if at least ``SIMILARITY`` of its windows are in one of its occurrences, or in all of them together. What stood in
the places of placeholders must be consistent: within an occurrence each filler has one counterpart in the document, and counterparts of different fillers of one type differ, so a question whose numbers or
names were replaced throughout is found, and a chance likeness of templates is not.

Scale. A document's text never leaves its task: only windows that the items have, few, are shuffled, by document and item. The items' distinct
hashes are broadcast only if there are at most ``BROADCAST_ROWS`` of them (counted first); beyond that the same join is shuffled.

Null and empty texts have no windows. An item with fewer tokens than a window has one window, of all its tokens, and documents then have
windows of that length as well. Repeated
rows give repeated results; a null doc_id or item_id is reported as null. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, read_table, small_side, tasks_for

WINDOW, LITERALS, SIMILARITY, LEAST_HITS = 5, 3, 0.8, 3
BROADCAST_ROWS = 1_000_000
_BLANKS = r"[\x20\x09-\x0D]+"

# Placeholders; the control characters do not occur in words that were not replaced (they are removed from texts first).
NAME, NUMBER, UNIT = "\x01n", "\x01d", "\x01u"
MARK = "\x02"
#: Forms that windows are read in: folded words, the template, and the template with names at starts of sentences too.
FOLDED, FIRST, SECOND = 0, 1, 2
#: What the hashes of a form begin with where its view stands for no other.
SEEDS = {FOLDED: 1, FIRST: 2, SECOND: 2}
#: Units (fixed word list), recognised behind a number only.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonne tonnes ounce ounces pound pounds ml l litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent degrees celsius fahrenheit "
    "dollar dollars cent cents euro euros rupees yen usd eur gbp kmh mph kb mb gb tb hz khz mhz ghz watt watts volt volts joules"
)
_NAME_PATTERN = r"(?<=[\p{L}\p{N},;][\x20\x09])\p{Lu}[\p{L}\p{M}'’-]*"
#: What is capitalised elsewhere, at the start of a sentence, line or quotation: perhaps a name.
_START_PATTERN = r"(?<![\p{L}\p{M}\p{N}'’\x01-])(\p{Lu}[\p{L}\p{M}'’-]*)"
_NUMBER_PATTERN = r"(?<![\p{L}\p{N}])[$€£]?[0-9]++(?:[.,:/][0-9]++)*%?(?![\p{L}\p{N}])"
_LONE_PATTERN = r"(?<![^\x20\x09-\x0D])[\p{P}\p{S}]++(?![^\x20\x09-\x0D])"


def spelled_numbers() -> list[str]:
    """English number words as they are written without hyphens; a lone "one" is mostly no number and left out."""
    ones = "one two three four five six seven eight nine".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()
    teens = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    return ["zero", *ones[1:], *teens, *tens, *[t + o for t in tens for o in ones], "hundred", "thousand", "million", "billion"]


#: What a token is: a literal, a name, perhaps a name (at the start of a sentence), a number.
LITERAL, SURE, PERHAPS, DIGITS = range(4)


def _canonical(text: Column) -> Column:
    """The text with placeholders of numbers and names, lower case, without punctuation; ``MARK`` before words that may be names."""
    text = F.regexp_replace(text, _NUMBER_PATTERN, NUMBER)
    text = F.regexp_replace(text, _NAME_PATTERN, NAME)
    text = F.regexp_replace(text, _START_PATTERN, MARK + "$1")
    return F.regexp_replace(F.lower(text), r"[\p{P}\p{S}]+", "")


def _tokens(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, and of the column text two arrays: ``folded``, codes of the folded words, and ``template``, where neighbouring names or
    numbers are one token: its code in the second template, in the first where it may be no name (else null), and a code of the
    words that a placeholder stands for (0: no placeholder in either template)."""
    # words of punctuation alone go first, so that the words of both readings stay side by side and none of them is empty
    clean = F.regexp_replace(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\x01\x02", ""), _LONE_PATTERN, "")
    frame = rows.select(*keep, F.btrim(clean, F.lit(" \t\n\x0b\x0c\r")).alias("text"))
    folded = F.regexp_replace(F.lower("text"), r"[\p{P}\p{S}]+", "")
    none = F.col("text") == ""
    split = lambda text: F.when(~none, F.split(text, _BLANKS)).otherwise(F.array().cast("array<string>"))
    frame = frame.withColumns({"canon": split(_canonical(F.col("text"))), "folded": split(folded)})
    spelled, units = spelled_numbers(), UNITS.split()

    def word(canon: Column, folded: Column) -> Column:
        # most words are no special ones, and are looked up once
        special = folded.isin([*spelled, *units])
        kind = F.when(canon == NUMBER, DIGITS).when(canon == NAME, SURE).when(special & folded.isin(spelled), DIGITS).when(canon.startswith(MARK), PERHAPS).otherwise(LITERAL)
        return F.struct(F.xxhash64(folded).alias("folded"), kind.alias("kind"), (special & folded.isin(units)).alias("unit"))

    frame = frame.select(*keep, F.zip_with("canon", "folded", word).alias("words"))

    def goes_on(before: Column, kind: Column) -> Column:
        """Whether a token of a kind is one with the token before it."""
        return ((kind == SURE) & before.isin(SURE, PERHAPS)) | ((kind == DIGITS) & (before == DIGITS))

    def token(w: Column, i: Column) -> Column:
        before, after, last = (F.coalesce(F.get("words", i + j)["kind"], F.lit(LITERAL)) for j in (-1, 1, 2))
        second = F.when(goes_on(w["kind"], after), F.get("words", i + 1)["folded"])
        third = F.when(second.isNotNull() & goes_on(after, last), F.get("words", i + 2)["folded"])
        literal = (w["kind"] == LITERAL) & ~(w["unit"] & (before == DIGITS))
        code = F.when(w["kind"] == DIGITS, F.xxhash64(F.lit(NUMBER))).when(w["kind"] == LITERAL, F.xxhash64(F.lit(UNIT))).otherwise(F.xxhash64(F.lit(NAME)))
        filler = F.hash(code, w["folded"], second, third).bitwiseOR(F.lit(1))
        plain = F.struct(w["folded"].alias("second"), F.lit(None).cast("long").alias("first"), F.lit(0).alias("filler"))
        one = F.struct(code.alias("second"), F.when(w["kind"] == PERHAPS, w["folded"]).alias("first"), filler.alias("filler"))
        return F.when(literal, plain).when(~goes_on(before, w["kind"]), one)

    return frame.select(*keep, F.col("words.folded").alias("folded"), F.array_compact(F.transform("words", token)).alias("template"))


def windows_of(rows: DataFrame, keep: list[str], lengths: Sequence[int], both_seeds: bool = False) -> DataFrame:
    """``keep`` columns, place (among the folded words, or the tokens of a template), and the array ``views`` of the window of each of ``lengths`` that begins there, once for each form that it is read in.

    A view has form, length, hash (null: no such window, too few literals in a template, or the second like the first), and the
    fillers at its first and last token (0: no placeholder). Each token is the first or the last of some window, so all fillers are there.
    A window that the first template reads as literals alone reads the same when folded. Where places are the same too, as no tokens became one,
    the folded view stands for the first template's as well (its hash begins with 0); else the forms have hashes of their own (``SEEDS``).
    Items have both (``both_seeds``).
    """
    tokens = _tokens(rows, keep)
    later = [F.col("folded"), *[F.slice("folded", F.lit(j + 1), F.greatest(F.size("folded") - j, F.lit(0))) for j in range(1, max(lengths))]]
    later += [F.col("template"), *[F.slice("template", F.lit(j + 1), F.greatest(F.size("template") - j, F.lit(0))) for j in range(1, max(lengths))]]
    names = [f"{kind}{j}" for kind in "dt" for j in range(max(lengths))]
    zipped = F.arrays_zip(*[t.alias(name) for t, name in zip(later, names, strict=True)])
    same = (F.size("folded") == F.size("template")).alias("same")
    # not explode: its inferred filter on the array's size would compute the tokens a second time, below the projections that hold their parts
    frame = tokens.select(*keep, same, zipped.alias("zipped")).select(*keep, "same", F.posexplode_outer("zipped").alias("place", "z"))
    fields = {"second": "s", "first": "a", "filler": "f"}
    parts = [F.col(f"z.t{j}.{long}").alias(f"{short}{j}") for j in range(max(lengths)) for long, short in fields.items()]
    frame = frame.select(*keep, "same", "place", *[F.col(f"z.d{j}").alias(f"d{j}") for j in range(max(lengths))], *parts)
    frame = frame.where(F.col("d0").isNotNull())

    def count(conditions: list[Column]) -> Column:
        return sum((c.cast("int") for c in conditions[1:]), conditions[0].cast("int"))

    views, own = [], []
    for n in lengths:
        span = range(n)
        there = F.col(f"s{n - 1}").isNotNull()
        marks = count([F.col(f"a{j}").isNotNull() for j in span])
        slots = count([F.coalesce(F.col(f"f{j}") != 0, F.lit(False)) for j in span])
        enough = min(LITERALS, n)
        one = lambda j: F.when(F.col(f"a{j}").isNull(), F.col(f"f{j}")).otherwise(F.lit(0))
        joint = {FOLDED: F.col("same") & (slots == marks), FIRST: F.col("same"), SECOND: F.col("same")}
        seed = lambda form: F.when(joint[form], F.lit(0)).otherwise(F.lit(SEEDS[form]))
        literals = there & (n - slots + marks >= enough)
        forms = [
            (FOLDED, F.col(f"d{n - 1}").isNotNull(), [F.col(f"d{j}") for j in span], F.lit(0), F.lit(0)),
            (FIRST, literals & (~F.col("same") | (slots > marks)), [F.coalesce(f"a{j}", f"s{j}") for j in span], one(0), one(n - 1)),
            (SECOND, there & (marks > 0) & (n - slots >= enough), [F.col(f"s{j}") for j in span], F.col("f0"), F.col(f"f{n - 1}")),
        ]
        for form, usable, codes, first, last in forms:
            views.append(F.struct(F.lit(form).alias("form"), F.lit(n).alias("length"), F.when(usable, F.xxhash64(seed(form), *codes)).alias("hash"), first.alias("first"), last.alias("last")))
        if both_seeds:
            for form, usable, codes, first, last in forms:
                every = literals if form == FIRST else usable
                for number in (0, SEEDS[form]):
                    code = F.when(every, F.xxhash64(F.lit(number), *codes)).alias("hash")
                    own.append(F.struct(F.lit(form).alias("form"), F.lit(n).alias("length"), code, first.alias("first"), last.alias("last"), marks.alias("marks")))
    return frame.select(*keep, "place", F.array(*(own if both_seeds else views)).alias("views"))


def _exploded(rows: DataFrame, keep: list[str], lengths: Sequence[int], both_seeds: bool = False) -> DataFrame:
    frame = windows_of(rows, keep, lengths, both_seeds).select(*keep, "place", F.explode_outer("views").alias("v"))
    return frame.select(*keep, "place", "v.*").where(F.col("hash").isNotNull())


def windows_of_items(items: DataFrame) -> DataFrame:
    """item_key, item_id, form, length, hash, at, own_first, own_last, n_windows (places of the item in that form): ``items`` has item_id and text."""
    keyed = items.withColumn("item_key", F.xxhash64("item_id", "text"))
    keep = ["item_key", "item_id"]
    # the first word of an item may stand inside a sentence of a document: its window is there in both forms
    inside = _exploded(keyed.withColumn("text", F.concat(F.lit("x "), F.ltrim("text"))), keep, range(1, WINDOW + 1), True).where((F.col("place") == 1) & (F.col("form") == FIRST))
    every = _exploded(keyed, keep, range(1, WINDOW + 1), True).unionByName(inside.withColumn("place", F.lit(0)))
    length = F.least(F.size("folded"), F.lit(WINDOW))
    sizes = _tokens(keyed, keep).select("item_key", length.alias("own_length"), (F.size("template") - length + 1).alias("n_places"))
    every = every.join(sizes.select("item_key", "own_length"), "item_key").where(F.col("length") == F.col("own_length")).drop("own_length")
    # a window that reads the same in both templates is there once: here it belongs to each of them
    both = (F.col("form") == FIRST) & (F.col("marks") == 0)
    every = every.withColumn("form", F.explode(F.when(both, F.array(F.lit(FIRST), F.lit(SECOND))).otherwise(F.array("form"))))
    every = every.select(*keep, "form", "length", "hash", F.col("place").alias("at"), F.col("first").alias("own_first"), F.col("last").alias("own_last")).distinct()
    totals = every.groupBy("item_key", "form").agg(F.count_distinct("at").alias("n_windows"))
    # a second template in which less than half of the windows have enough literals says too little
    totals = totals.join(sizes.select("item_key", "n_places"), "item_key").where((F.col("form") != SECOND) | (2 * F.col("n_windows") >= F.col("n_places"))).drop("n_places")
    return every.join(totals, ["item_key", "form"])


def occurrences(hits: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, occurrence, n_found, slots: the places of an item found in each occurrence, and their fillers.

    ``hits`` has ``keys``, n_windows, offset, at and slots. Hits of one offset are a line; lines of too few hits are left out.
    Lines whose offsets are close to each other are one occurrence (words were put in or left out), and all lines of the document
    together are one as well (occurrence -1), for an item with long insertions. A place counts in its longest line only, so a stray line
    beside a copy has no say.
    """
    line = Window.partitionBy(*keys, "offset")
    lines = hits.withColumn("held", F.size(F.collect_set("at").over(line))).where(F.col("held") >= F.least(F.lit(LEAST_HITS), F.col("n_windows")))
    along = Window.partitionBy(*keys).orderBy("offset", "at")
    apart = 2 * (F.col("offset") - F.lag("offset").over(along)) > F.col("n_windows")
    marked = lines.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int"))
    marked = marked.withColumn("nth", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    either = marked.withColumn("occurrence", F.explode(F.array(F.col("nth"), F.lit(-1).cast("long"))))
    best = either.groupBy(*keys, "occurrence", "at").agg(F.max(F.struct("held", -F.col("offset"), "slots")).alias("best"))
    return best.groupBy(*keys, "occurrence").agg(F.count(F.lit(1)).alias("n_found"), F.array_distinct(F.flatten(F.collect_list("best.slots"))).alias("slots"))


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_key, item_id, n_windows, n_found, similarity, n_changed: one row for each document and item found in it.

    ``n_changed``: fillers that differ from the item's; zero for a copy as it stands. Where several forms or occurrences are
    found, the row tells of one in a template before a folded one, then of the most similar, then of the least changed.
    """
    numbered = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    of_items = cut(windows_of_items(numbered), tasks_for(1000 * numbered.count()))
    lengths = sorted({r["length"] for r in of_items.select("length").distinct().collect()}) or [WINDOW]  # at most WINDOW of them
    hashes = of_items.select("hash").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).withColumns({"row": F.monotonically_increasing_id(), "text_key": F.xxhash64(F.col("text").cast("string"))})
    of_docs = _exploded(rows, ["row", "doc_id", "text_key"], lengths).select("row", "doc_id", "text_key", "place", "length", "hash", "first", "last")
    small = hashes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hits = of_docs.join(F.broadcast(hashes) if small else hashes, "hash", "left_semi")
    hits = hits.join(of_items, ["hash", "length"])
    doc = ["row", "doc_id", "text_key", "item_key", "item_id", "form", "n_windows"]
    slots = F.array(F.struct(F.col("own_first").alias("own"), F.col("first").alias("other")), F.struct(F.col("own_last").alias("own"), F.col("last").alias("other")))
    rowed = hits.select(*doc, (F.col("place") - F.col("at")).alias("offset"), "at", F.filter(slots, lambda s: s["own"] != 0).alias("slots"))
    # by all that the occurrences of a document and item are told apart by, so they need no other shuffle
    both = occurrences(rowed.repartition("row", "item_key"), doc)
    n = F.size("slots")
    consistent = (F.size(F.array_distinct("slots.own")) == n) & (F.size(F.array_distinct("slots.other")) == n)
    changed = F.size(F.filter("slots", lambda s: s["own"] != s["other"])).cast("long")
    both = both.withColumns({"similarity": F.col("n_found") / F.col("n_windows"), "n_changed": changed})
    found = both.where((F.col("similarity") >= SIMILARITY) & consistent)
    rank = F.struct((F.col("form") != FOLDED).alias("template"), "similarity", -F.col("n_changed"), -F.col("form"), F.col("n_windows"), F.col("n_found"), F.col("n_changed"))
    best = found.groupBy("row", "doc_id", "text_key", "item_key", "item_id").agg(F.max(rank).alias("best"))
    return best.select("doc_id", "text_key", "item_id", *[F.col(f"best.{c}").cast("long").alias(c) for c in ("n_windows", "n_found")], "best.similarity", "best.n_changed")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows and columns of the documents in which no item was found."""
    leaks = small_side(find_leaks(docs, items).select(F.col("doc_id").alias("leaked_id"), F.col("text_key").alias("leaked_key")).distinct())
    # columns taken from their tables, so that ``docs`` may have columns of these names too
    same = docs["doc_id"].cast("long").eqNullSafe(leaks["leaked_id"]) & (F.xxhash64(docs["text"].cast("string")) == leaks["leaked_key"])
    return docs.join(leaks, same, "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item found in it, over all of ``documents``."""
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_key")
