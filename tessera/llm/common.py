"""What several corpus operators share: the checkpoint folder, reading of tables, and vectorised word tables."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space of the word pattern ``[^\x20\x09-\x0D]+``: the ASCII white space that ``bytes.split`` knows.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names in ``spark.checkpoint.dir``; where it is unset, one of our own if all runs on this machine, else an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


#: Narrow rows in a task, and tasks at least, where a table is known to be small.
ROWS_IN_TASK, FEWEST_TASKS = 200_000, 12


def tasks_for(rows: int) -> int:
    """Tasks, and so files, that some narrow rows are worth: few rows need not have one for each of the shuffle's partitions."""
    return max(FEWEST_TASKS, -(-rows // ROWS_IN_TASK))


def cut(frame: DataFrame, tasks: int | None = None) -> DataFrame:
    """The same rows from files in the shared checkpoint folder (at most ``tasks`` of them): lineage ends there, and a lost executor loses nothing."""
    ensure_checkpoint_dir(frame.sparkSession)
    return (frame if tasks is None else frame.coalesce(tasks)).checkpoint(eager=True)


def hinted(frame: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """The same rows, marked for broadcast only if there are at most ``rows`` of them (narrow rows are meant); else joins shuffle them. They are counted, so they should come from files."""
    from pyspark.sql import functions as F

    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def small_side(frame: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """:func:`hinted`, the rows written to files first."""
    return hinted(cut(frame), rows)


#: Rows that a join's key may have in one task in any case, and keys with more, at most.
PART_ROWS, MOST_HOT = 256, 10_000


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``key``, parts: the keys with more rows (column ``n``) than a part may have, and in how many parts their rows go. ``total``: the sum of all counts, so
    there are at most ``MOST_HOT`` such keys, of at most twice as many parts together, whatever the number of rows."""
    from pyspark.sql import functions as F

    each = max(PART_ROWS, -(-total // MOST_HOT))
    return counts.where(F.col(n) > each).select(key, F.ceil(F.col(n) / F.lit(each)).cast("int").alias("parts"))


def dealt_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, lot, how: str = "inner") -> DataFrame:
    """``left.join(right, key, how)``, where rows of ``left`` with a key of ``hot`` (:func:`hot_keys`, broadcast) are dealt to that key's parts by the
    number ``lot``, and rows of ``right`` with such a key are there once for each part; all other rows as they are."""
    from pyspark.sql import functions as F

    hot = F.broadcast(hot)
    dealt = left.join(hot, key, "left").withColumn("part", F.coalesce(F.pmod(lot, F.col("parts")), F.lit(0).cast("long"))).drop("parts")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts").cast("long"), F.lit(1).cast("long")) - 1))
    return dealt.join(right.join(hot, key, "left").withColumn("part", every).drop("parts"), [key, "part"], how).drop("part")


#: Bytes in an Arrow batch at most (a row at least). Spark's own bound is 64 MB, which the JVM and Python each hold more than once.
BATCH_BYTES = 4 << 20


def map_arrow(frame: DataFrame, work, schema) -> DataFrame:
    """``frame.mapInArrow`` in batches of at most ``BATCH_BYTES``: the session's bound is lowered to that, never raised."""
    bound, conf = "spark.sql.execution.arrow.maxBytesPerBatch", frame.sparkSession.conf
    number, unit = re.fullmatch(r"(-?\d+)([a-z]?)b?", conf.get(bound, str(64 << 20)).lower()).groups()
    if not 0 < int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 0) <= BATCH_BYTES:
        conf.set(bound, str(BATCH_BYTES))
    return frame.mapInArrow(work, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array | pa.ChunkedArray) -> Iterator[str]:
    """Texts of an Arrow column, some hundreds at a time in Python's memory; null is the empty text."""
    for start in range(0, len(column), 256):
        for text in column.slice(start, 256).to_pylist():
            yield text or ""


# --- word tables: words of many texts at once, in numpy ---

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _random_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)


_BYTE_CODE = _random_table(20_231)
_POWERS = np.ones(1, dtype=np.uint64)
_UNPOWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the hash base modulo 2^64, and of its inverse."""
    global _POWERS, _UNPOWERS
    if len(_POWERS) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]))
            _UNPOWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _UNBASE)]))
    return _POWERS[:n], _UNPOWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of value * base^position, with a leading zero: ``span_hash`` takes any span's hash from them."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free hashes of the spans [start, end); equal spans have equal hashes."""
    with np.errstate(over="ignore"):
        return (prefix[ends] - prefix[starts]) * powers(len(prefix) + 1)[1][starts]


class WordTable:
    """The words of one batch of texts: byte spans in one buffer, a 64-bit hash of each, and how many each text has.

    Texts lie one after the other in the buffer, a newline between, so that no word spans two of them.
    """

    def __init__(self, texts: list[bytes], lower: bool = False) -> None:
        joined = b"\n".join(texts)
        self.raw = joined.lower() if lower else joined  # bytes.lower changes A-Z only
        self.buffer = np.frombuffer(self.raw, dtype=np.uint8)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.text_starts = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] if len(texts) else np.zeros(0, np.int64)
        self.text_ends = self.text_starts + lengths
        inside = np.zeros(len(self.buffer) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[self.buffer]
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.starts, self.text_starts)  # of each text's words
        self.last = np.searchsorted(self.starts, self.text_ends)
        self.counts = self.last - self.first

    def hashes(self) -> np.ndarray:
        """A well mixed 64-bit hash of each word's bytes."""
        prefix = prefix_hash(_BYTE_CODE[self.buffer])
        return mix(span_hash(prefix, self.starts, self.ends) + (self.ends - self.starts).astype(np.uint64))


def sub_batches(texts: list[bytes], size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together (one text at least), which bounds what numpy holds at once."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= size:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


# --- labelled samples ---


def fold_of(doc_id) -> "Column":  # noqa: F821
    """crc32 of the id as text, modulo 5 (a null id counts as empty text)."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int, extra: tuple = ()) -> DataFrame:
    """doc_id, text, extra columns, label of at most ``size`` ids outside fold 0: those with the least hash of the id.

    The ids alone are broadcast, so ``size`` bounds that. An id labelled more than once has its largest label.
    """
    from pyspark.sql import functions as F

    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    ids = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)
    return texts.join(F.broadcast(ids), "doc_id")
