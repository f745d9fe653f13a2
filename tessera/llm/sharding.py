"""Operator 5: shards of equal row counts by balanced label propagation. DataFrame functions only.

Documents with equal texts are linked. Each document starts in the shard that its id hashes to (without an id: its text, or
of a text with very many copies its place in the input); in each round linked documents move
towards the shard where most of their neighbours are, those who gain most first, as long as the shard's quota has room for
them. What is left (documents without links, and linked ones beyond a shard's share) fills the shards up, so that their counts
differ by at most one (law ``rows``).

Scale. Copies of one text are one vertex set, counted by (text, shard) before anything moves, so a round handles counts, not documents,
and emits no pairs. A text with more than 1/8 of a shard's copies is dealt into pieces of that size, which move one by one but stay linked
by their parent, a set of up to a shard's copies of the text: pieces are drawn to the shard that has most of the parent, and where that has no room
to the shard that has most of the piece. Pieces are dealt by id, or without one by place in the input;
rows of one id and one text move as one. There are at most 8 times as many such texts as shards, which bounds their broadcast. Quotas are shared out by a histogram of
gains (at most shards x shards x ``LEVELS`` counts, which the driver gets), not by sorting movers. Places within a shard come from one range sort with prefix
sums over partitions. Only counts by shard and by partition reach the driver. ``ROUNDS`` bounds the work, not the law: :func:`cut_share` counts
the edges that are left between shards.

Null text has size 16, checksum 0 and is linked to other null texts only. Null and repeated doc_ids are documents like any other. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, read_table, shuffle_partitions, tasks_for

SHARDS, ROUNDS, OVERHEAD = 40, 6, 16
PIECES_PER_SHARD, LEVELS, SLACK = 8, 40, 20
_TEXT = ["key", "text_crc32", "size"]


def _base(docs: DataFrame, shards: int) -> DataFrame:
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    doc_id = F.col("doc_id").cast("long")
    key = F.xxhash64(text, text.isNull())
    return docs.select(
        doc_id.alias("doc_id"), size.alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        key.alias("key"), F.pmod(F.xxhash64(F.coalesce(doc_id, key)), F.lit(shards)).cast("int").alias("start"), F.monotonically_increasing_id().alias("nth"),
    )


def _pieces(base: DataFrame, n: int, shards: int) -> DataFrame:
    """The rows with ``piece``, the set of linked documents that moves as one, null for a document without links, and its ``parent``."""
    most = max(2, n // (shards * PIECES_PER_SHARD))
    quota = max(most, n // shards)
    groups = cut(base.groupBy(*_TEXT).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), tasks_for(n))
    large = groups.where(F.col("n") > most).select(*_TEXT, "n", F.ceil(F.col("n") / F.lit(quota)).cast("int").alias("parents"))
    large = large.select(*_TEXT, "parents", (F.col("parents") * F.ceil(F.col("n") / (F.col("parents") * most))).cast("int").alias("parts"))
    marked = base.join(F.broadcast(large), _TEXT, "left")  # at most shards * PIECES_PER_SHARD + 1 rows
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", "nth"), F.lit(1)), F.col("parts"))
    dealt, parent = F.xxhash64(*_TEXT, part), F.xxhash64(*_TEXT, F.pmod(part, F.col("parents")), F.lit(-2))
    names = ["doc_id", "size", "text_crc32", "start"]
    start = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("nth"), F.lit(shards)).cast("int")).otherwise(F.col("start")).alias("start")
    hot = marked.where(F.col("parts").isNotNull()).select(*names[:3], start, dealt.alias("piece"), parent.alias("parent"))
    small = groups.where(F.col("n") <= most).select(*_TEXT, F.xxhash64(*_TEXT, F.lit(-1)).alias("piece"))
    rest = marked.where(F.col("parts").isNull()).join(small, _TEXT, "left").select(*names, "piece", F.col("piece").alias("parent"))
    return hot.unionByName(rest)


def _at(values: list[int], place: Column) -> Column:
    return F.get(F.array(*[F.lit(int(v)).cast("long") for v in values]), place)


def _by_shard(frame: DataFrame, what: Column, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in frame.groupBy("shard").agg(what.alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def grant(asked: dict[tuple[int, int, int], int], loads: list[int], quotas: list[int]) -> list[float]:
    """The share of wishes to grant for each (wish, level), as one list: the most gainful first, so many that no shard's load exceeds its quota.

    What leaves a shard makes room in it. All wishes are granted at first; then shards that would be too full turn away the least
    gainful, which may fill others, until none is. Shares only fall, so this ends.
    """
    shards = len(quotas)
    flow = np.zeros((shards, shards, LEVELS))
    for (here, wish, level), n in asked.items():
        flow[here, wish, level] += n
    wanted = flow.sum(axis=0)
    before = np.cumsum(wanted, axis=1) - wanted
    room = wanted.sum(axis=1)
    shares = np.ones((shards, LEVELS))
    for _ in range(1000):
        leaving = (flow * shares).sum(axis=(1, 2))
        less = np.minimum(room, np.maximum(0, np.array(quotas) - np.array(loads) + leaving))
        if (room - less).max(initial=0) < 0.5:
            break
        room = less
        shares = np.clip((room[:, None] - before) / np.maximum(wanted, 1), 0, 1) * (wanted > 0)
    return shares.ravel().tolist() if asked else []


def propagate(cells: DataFrame, quotas: list[int], rounds: int = ROUNDS, tasks: int | None = None) -> DataFrame:
    """piece, parent, start, n, shard: cells (piece, start, n, and parent if there) after some rounds of moves under quotas of rows for each shard.

    In each round pieces move towards their parent's shard, then what that has no room for towards the piece's own. Cells are kept in at most ``tasks`` files.
    """
    shards = len(quotas)
    linked_by = ["parent", "piece"] if "parent" in cells.columns else ["piece"]
    names = [*linked_by, "start", "n"]
    cells = cut(cells.withColumn("shard", F.col("start")), tasks)
    for turn in range(rounds):
        moved = False
        for key in linked_by:
            loads = _by_shard(cells, F.sum("n"), shards)
            held = cells.groupBy(key, "shard").agg(F.sum("n").alias("m"))
            # which of equals is best changes with the round, so that a refused vertex set asks elsewhere next time
            rank = F.struct(F.col("m"), F.xxhash64(key, "shard", F.lit(turn)).alias("tie"), F.col("shard"))
            best = held.groupBy(key).agg(F.max(rank).alias("best"))
            joined = cells.join(held, [key, "shard"]).join(best, key)
            gain = F.col("best.m") - F.col("m")
            moves = F.col("best.shard") != F.col("shard")
            level = F.lit(LEVELS - 1) - F.least(F.lit(LEVELS - 1), F.floor(F.log2(gain + 1)).cast("int"))
            wish = F.when(moves, F.col("best.shard"))
            wished = cut(joined.select(*names, "shard", wish.alias("wish"), F.when(moves, level).alias("level")), tasks)
            asked = wished.where(F.col("wish").isNotNull()).groupBy("shard", "wish", "level").agg(F.sum("n").alias("n")).collect()  # bounded: counts by shards and level
            shares = grant({(r["shard"], r["wish"], r["level"]): r["n"] for r in asked}, loads, quotas)
            if not any(shares):
                continue
            moved = True
            share = F.get(F.lit(shares), F.col("wish") * LEVELS + F.col("level"))
            lot = F.pmod(F.xxhash64("piece", F.lit(2)), F.lit(1 << 20)) / float(1 << 20)
            cells = cut(wished.select(*names, F.when(lot < share, F.col("wish")).otherwise(F.col("shard")).alias("shard")), tasks)
        if not moved:
            break
    return cells


def _numbered(frame: DataFrame) -> DataFrame:
    """The rows of a table from files with ``rank``, gapless from 0 in the order of its partitions."""
    placed = frame.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # one row for each partition
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("nth")).drop("part", "nth", "offset")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per document."""
    base = cut(_base(docs, shards))
    n = base.count()
    rows = cut(_pieces(base, n, shards), tasks_for(n))
    linked = rows.where(F.col("piece").isNotNull())
    quotas = [n // shards + (s < n % shards) for s in range(shards)]
    # a little room lets full shards exchange documents; what is too much in the end goes to the pool below
    loose = [q + q // SLACK + 1 for q in quotas]
    cells = propagate(linked.groupBy("piece", "parent", "start").agg(F.count(F.lit(1)).alias("n")), loose, rounds, tasks_for(n))
    placed = linked.join(cells.select("piece", "start", "shard"), ["piece", "start"])  # a piece has one parent
    parts = shuffle_partitions(docs.sparkSession)
    ordered = cut(placed.repartitionByRange(parts, "shard", "parent", "piece", "doc_id").sortWithinPartitions("shard", "parent", "piece", "doc_id"))
    counts = _by_shard(ordered, F.count(F.lit(1)), shards)
    first = [sum(counts[:s]) for s in range(shards)]
    kept = [min(c, q) for c, q in zip(counts, quotas, strict=True)]
    names = ["doc_id", "size", "text_crc32"]
    ranked = _numbered(ordered).withColumn("slot", F.col("rank") - _at(first, F.col("shard")))
    stays = F.col("slot") < _at(kept, F.col("shard"))
    settled = ranked.where(stays).select(*names, "shard", "slot")
    pool = cut(ranked.where(~stays).select(*names).union(rows.where(F.col("piece").isNull()).select(*names)))
    gaps = [q - k for q, k in zip(quotas, kept, strict=True)]
    below = [sum(gaps[:s]) for s in range(shards + 1)]
    # the shard whose gap the rank falls into: as many shards as have gaps that end at or below it
    ends = F.array(*[F.lit(int(b)).cast("long") for b in below[1:]])
    shard = F.size(F.filter(ends, lambda e: e <= F.col("rank"))).cast("int")
    filled = _numbered(pool).withColumn("shard", shard)
    filled = filled.select(*names, "shard", (F.col("rank") - _at(below, F.col("shard")) + _at(kept, F.col("shard"))).alias("slot"))
    out = settled.unionByName(filled)
    return out.select(*names, F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"))


def cut_share(sharded: DataFrame, key: list[str]) -> DataFrame:
    """edges, cut: pairs of linked documents (equal ``key`` columns), and how many of them have their ends in different shards. From counts, not from pairs."""
    pairs = lambda n: (F.col(n) * (F.col(n) - 1) / 2).cast("long")
    held = sharded.groupBy(*key, "shard").agg(F.count(F.lit(1)).alias("m"))
    groups = held.groupBy(*key).agg(F.sum("m").alias("n"), F.sum(pairs("m")).alias("inside"))
    sums = groups.agg(F.coalesce(F.sum(pairs("n")), F.lit(0)).alias("edges"), F.coalesce(F.sum("inside"), F.lit(0)).alias("inside"))
    return sums.select("edges", (F.col("edges") - F.col("inside")).alias("cut"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``documents``."""
    return shard_documents(read_table(spark, sf_dir, "documents"))
