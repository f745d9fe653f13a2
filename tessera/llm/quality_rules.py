"""Operator 7: quality rules, of each document and across documents. DataFrame functions only.

Base rules count what stands in one text. The cross-document rule hashes normalised lines (lower case, runs of white space as one
blank), counts for each host in how many different texts a line stands, and removes lines that stand in more than
``MIN_TEXTS`` of them from all but the first (least doc_id), so that one copy of a popular text survives. The limit is a number and no share:
a line's verdict does not loosen as its host grows. A document of whose characters in lines more than ``DEPLETED`` are removed is
rejected. ``judge`` gives counts and verdicts, ``kept_documents`` the documents with the lines removed.

The host of ``documents`` is its ``source``; a null source is a host of its own. Equal texts of one host count once, so repeated rows and
exact copies do not make a line frequent. Null text is empty (it has no words, so base rules reject it); a null doc_id is never
first. Columns other than doc_id, text and source are ignored. An empty table gives no rows.

Scale: a text is read three times (for copies by a hash alone) and not shuffled by :func:`judge`. Lines are distinct per document and summed per task
before they are shuffled by (line, text), and counted in partial sums; the frequent ones meet the lines again. The rows of a line or text
that very many have are dealt to many tasks (``common.dealt_join``), by their measured number; only such keys are repeated on the other side, so the
joins move each other row once however many partitions there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, dealt_join, hot_keys, read_table

MIN_TEXTS, DEPLETED = 20, 0.7
MIN_WORDS, MAX_REPEATED = 10, 20
BROADCAST_LINES = 1_000_000
_BLANKS = r"[\x20\x09-\x0D]+"
_NOT_BLANK = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]"


def _repeated(keys: Column) -> Column:
    """Windows (hash, place) whose hash occurs twice: neighbours in the sorted array."""
    n = F.size(keys)

    def twice(x: Column, k: Column) -> Column:
        before = (k > 0) & (x["h"] == F.get(keys, k - 1)["h"])
        return F.coalesce(before, F.lit(False)) | F.coalesce((k < n - 1) & (x["h"] == F.get(keys, k + 1)["h"]), F.lit(False))

    return F.filter(keys, twice)


def base_counts(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, host, text key, the base counts and a number ``nth`` of every document, and if ``whole`` its row as the struct ``row``.

    Repeated windows are found by sorting one array of 64-bit hashes and places in each row, so a long text costs n log n and nothing is exploded.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _host(docs).alias("host"), text.alias("text"), *[F.struct(*docs.columns).alias("row")] * whole)
    words = F.filter(F.split("text", _BLANKS), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_NOT_BLANK))
    rows = rows.withColumns({"words": words, "lines": lines, "text_key": F.xxhash64("host", "text"), "n_symbols": F.regexp_count("text", F.lit(_SYMBOLS)).cast("long")})
    rows = rows.withColumn("n_words", F.size("words").cast("long"))
    places = F.when(F.col("n_words") >= 5, F.sequence(F.lit(0), (F.col("n_words") - 5).cast("int"))).otherwise(F.array().cast("array<int>"))

    def key(i: Column) -> Column:
        return F.struct(F.xxhash64(*[F.get("words", i + j) for j in range(5)]).alias("h"), i.alias("i"))

    rows = rows.withColumn("keys", F.sort_array(F.transform(places, key)))
    rows = rows.withColumn("found", F.sort_array(F.transform(_repeated(F.col("keys")), lambda x: x["i"].cast("long"))))
    gaps = F.transform("found", lambda x, k: F.least(F.lit(5).cast("long"), F.coalesce(F.get("found", k + 1) - x, F.lit(5).cast("long"))))
    return rows.select(
        "doc_id", "host", "text_key", "n_words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        F.aggregate(F.transform("lines", lambda x: F.length(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("line_chars"),
        F.monotonically_increasing_id().alias("nth"),
        *["row"] * whole,
    )


def _host(docs: DataFrame) -> Column:
    return F.xxhash64(F.col("source").cast("string")) if "source" in docs.columns else F.lit(0).cast("long")


def normal_line(line: Column) -> Column:
    """A line as it is compared across documents."""
    return F.lower(F.trim(F.regexp_replace(line, _BLANKS, " ")))


def _lines(docs: DataFrame) -> DataFrame:
    """line, text_key (both hashed with the host), least doc_id of the text, characters of the line in all copies of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _host(docs).alias("host"), F.xxhash64(_host(docs), text).alias("text_key"), text.alias("text"))
    rows = rows.select("doc_id", "host", "text_key", F.explode_outer(F.split("text", "\n")).alias("raw")).where(F.col("raw").rlike(_NOT_BLANK))
    rows = rows.select(F.xxhash64("host", normal_line(F.col("raw"))).alias("line"), "text_key", "doc_id", F.length("raw").cast("long").alias("chars"))
    return rows.groupBy("line", "text_key").agg(F.min("doc_id").alias("first_id"), F.sum("chars").alias("chars"))


def frequent_lines(lines: DataFrame) -> DataFrame:
    """line, keeper (least doc_id that has it), n (texts that have it) of the lines above the limit."""
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min("first_id").alias("keeper")).where(F.col("n") > MIN_TEXTS)


def _total(counts: DataFrame) -> int:
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _copies(docs: DataFrame) -> DataFrame:
    """text_key, n: how many documents of its host have each text; from files."""
    key = F.xxhash64(_host(docs), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_key")
    return cut(docs.select(key).groupBy("text_key").agg(F.count(F.lit(1)).alias("n")))


def _removed(docs: DataFrame, copies: DataFrame, which: bool = False) -> DataFrame:
    """text_key, removed_chars of each text that loses lines, and if ``which`` the array ``lost`` of those lines; from files."""
    lines = cut(_lines(docs))
    frequent = cut(frequent_lines(lines))
    hot = hot_keys(frequent, "line", "n", _total(frequent))
    met = dealt_join(lines, frequent.select("line", "keeper"), "line", hot, F.col("text_key"))
    lost = met.where(F.col("first_id").isNull() | (F.col("first_id") != F.col("keeper")))
    sums = lost.groupBy("text_key").agg(F.sum("chars").alias("chars"), *[F.collect_list("line").alias("lost")] * which)
    return cut(sums.join(copies, "text_key").select("text_key", F.call_function("div", F.col("chars"), F.col("n")).alias("removed_chars"), *["lost"] * which))


def _with_removed(counts: DataFrame, removed: DataFrame, copies: DataFrame) -> DataFrame:
    """``counts`` (of :func:`base_counts`) and what its texts lose, a text of very many copies in many tasks."""
    hot = hot_keys(copies, "text_key", "n", _total(copies))
    return dealt_join(counts, removed, "text_key", hot, F.xxhash64(F.coalesce("doc_id", "nth")), "left")


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _kept(removed: Column) -> Column:
    return ~_failed() & ~(removed > DEPLETED * F.col("line_chars"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_failed, removed_chars, kept: one row per document."""
    copies = _copies(docs)
    joined = _with_removed(base_counts(docs), _removed(docs, copies), copies)
    removed = F.coalesce("removed_chars", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _failed().alias("base_failed"),
        _kept(removed).alias("kept"), removed.alias("removed_chars"),
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows and columns of the documents that are kept, their texts without the lines that the cross-document rule removes.

    Null text stays null; other columns are as they were. Texts are not shuffled unless very many lines are lost.
    """
    copies = _copies(docs)
    removed = _removed(docs, copies, which=True)
    n_lost = removed.agg(F.coalesce(F.sum(F.size("lost")), F.lit(0))).first()[0]
    counts = base_counts(docs, whole=True)
    joined = counts.join(F.broadcast(removed), "text_key", "left") if n_lost <= BROADCAST_LINES else _with_removed(counts, removed, copies)
    # the condition on ``nth``, always true, keeps the filter above the projections that compute the counts: below them it would
    # have their expressions in place of columns, and arrays would be computed again for each of their elements
    kept = joined.where((F.col("nth") >= 0) & _kept(F.coalesce("removed_chars", F.lit(0).cast("long"))))
    left = F.filter(F.split(F.col("row.text").cast("string"), "\n"), lambda x: ~F.array_contains("lost", F.xxhash64("host", normal_line(x))))
    text = F.when(F.col("lost").isNull(), F.col("row.text").cast("string")).otherwise(F.array_join(left, "\n"))
    return kept.select(*[text.cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``documents``."""
    return judge(read_table(spark, sf_dir, "documents")).drop("removed_chars")


#: The same rows for an SQL engine.
OP7_SQL = """
with docs as (select doc_id, coalesce(source, chr(1)) as host, coalesce(text, '') as text from documents),
  split as (select doc_id, host, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from docs),
  windows as (select doc_id, i, words[i : i + 4] as w from (select doc_id, words, unnest(generate_series(1, len(words) - 4)) as i from split)),
  twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as n from windows) where n > 1),
  covered as (select doc_id, count(distinct i + j) as n_repeat_words from twice, generate_series(0, 4) g(j) group by doc_id),
  raw as (select doc_id, host, text, unnest(lines) as x from split),
  texts as (select host, text, count(*) as copies from docs group by host, text),
  per_text as (select host, text, lower(trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g'))) as line, min(doc_id) as first_id, sum(length(x)) as chars from raw group by all),
  frequent as (select host, line, min(first_id) as keeper from per_text group by host, line having count(*) > 20),
  lost as (select host, text, sum(chars) as chars from per_text join frequent using (host, line) where first_id is null or first_id <> keeper group by host, text),
  base as (select doc_id, host, text, len(words) as n_words, length(array_to_string(words, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) as line_chars from split)
select b.doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
  n_words < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * coalesce(n_repeat_words, 0) > 20 * n_words) and not coalesce(l.chars / copies, 0) > 0.7 * line_chars as kept
from base b left join covered using (doc_id) left join lost l on l.host = b.host and l.text = b.text left join texts t on t.host = b.host and t.text = b.text
"""
