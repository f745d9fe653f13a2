"""Groups of documents that ask questions by key and get answers: the frame of the exact-repeat operators.

Documents are dealt into groups by a hash of id, text and input partition, once; every phase reads that one shuffle again. A group asks about
each key once, however many of its documents have it, in blocks of packed keys: one row for each group and bucket of keys. A
bucket's rows stream in sorted order through a task, which sends answers back by group. So a key that a third of all documents have
costs one entry for each group, and no task holds more than one bucket's keys or one group's documents.

Scale: the numbers of groups and of buckets follow the bytes of all texts, which are summed first, so neither a group nor a bucket grows with
the corpus. With very many buckets a block holds few keys, and at worst there is a row for each key: the shuffle is then several
times larger for each byte of text, but in proportion to the texts, never to their square. Tasks are bounded, as a task takes its
groups or buckets one after the other. None of these numbers changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_partitions

#: Bytes of text in a group on average, groups in a task at least, and tasks at most (beyond that each takes more groups or buckets).
GROUP_BYTES, GROUPS_IN_TASK, MOST_TASKS = 4 << 20, 4, 20_000
#: Buckets that are made for parallelism alone, at most.
FEW_BUCKETS = 512


@dataclass(frozen=True)
class Deal:
    """Documents dealt into groups: ``rows`` (g, doc_id, text), partitioned by g into ``parts``."""

    rows: DataFrame
    size: int
    parts: int

    def buckets(self, each: int) -> int:
        """A number of buckets with the keys of at most ``each`` bytes of text in one (on average)."""
        return max(1, min(self.parts // 2, FEW_BUCKETS), -(-self.size // each))

    def by_bucket(self, asked: DataFrame, buckets: int, *order: str) -> DataFrame:
        """``asked`` with each bucket in one task, buckets dealt evenly and sorted one after the other."""
        tasks = min(buckets, MOST_TASKS)
        return asked.repartitionById(tasks, F.pmod(F.col("bucket"), F.lit(tasks))).sortWithinPartitions("bucket", *order)


def deal(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> Deal:
    """Documents by group, null text empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    least = shuffle_partitions(docs.sparkSession)
    groups = max(GROUPS_IN_TASK * least, -(-size // group_bytes))
    parts = max(least, min(groups // GROUPS_IN_TASK, MOST_TASKS))
    # the input partition is hashed too, so that a row which is repeated very often is dealt to many groups
    group = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(groups)).cast("int")
    return Deal(rows.select(group.alias("g"), "doc_id", "text").repartition(parts, "g"), size, parts)


def texts_and_ids(table: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """UTF-8 texts, ids (0 where null) and whether each id is there, of one group's rows."""
    column = table.column("doc_id").combine_chunks()
    known = ~np.asarray(column.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    ids = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return [t.as_py() for t in table.column("text").cast(pa.binary())], ids, known


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned values as differences, byte planes apart, so that the shuffle's compression drops the empty ones."""
    steps = np.diff(values, prepend=values[:1] * 0)
    return steps.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    """The values of :func:`pack`."""
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, len(data) // width)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


def pack_plain(values: np.ndarray) -> bytes:
    """Values in any order, byte planes apart."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack_plain(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(np.dtype(kind).itemsize, len(data) // np.dtype(kind).itemsize)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def found_in(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted value whether it is among the sorted ones, and where."""
    if not len(sorted_values):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted, at
