"""Operator 1: near duplicates by SimHash, joined by anchor-point covering.

Fingerprints. Words of the text (A-Z in lower case), 3-word shingles with repeats, XXH64 of each; a bit is set if it is set in over half the
hashes. Two fingerprints link if they differ in at most ``THRESHOLD`` bits.

Anchors. The 64 bits are cut into blocks, each with the code {all zeros, all ones}; the product of these codes is a covering code, its
codewords are the anchors, and the nearest codeword of a fingerprint takes the majority of each block. A fingerprint is a probe at
its nearest anchor. It is replicated as an index entry to every anchor that is the nearest of some fingerprint within the threshold
(all of them lie within covering radius plus threshold): to move a block's majority costs a known number of bits, and any set of blocks
whose costs sum to at most the threshold gives one such anchor. So each link is met at the nearest anchor of either end, and
fingerprints are compared there only. More blocks give more anchors with fewer entries each but more replicas; :func:`blocks_for`
takes the cheapest for the number of distinct fingerprints. Only speed depends on that choice, never a link.

Skew. Equal fingerprints are one entry, whatever the number of documents. An anchor with more than ``CELL`` probes is split into a
grid of cells, each with a part of its probes and a part of its index; in a cell, index entries stream past the probes in sorted
order. Of a group of near copies only a tree of links of few branches leaves a cell, never its pairs. Components are then joined across anchors.

A null or blank text has fingerprint zero and links like any other. A null doc_id counts as no id: such a row has its component's
least id (null if there is none). Repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
:func:`keep_one_of_each` keeps one row of each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, dealt_join, hinted, hot_keys, map_arrow, mix, read_table, tasks_for, texts_of
from tessera.llm.components import component_labels

SEED, SHINGLE, THRESHOLD = 42, 3, 3
#: Probes in a cell at most, on average; entries compared at once; branches of a group's tree of links.
CELL, TILE, FAN = 2048, 1 << 20, 8
#: Numbers of blocks to choose from, and the costs of one replica and of one comparison (ns).
BLOCKS, REPLICA_COST, COMPARE_COST = (13, 16, 21, 32), 300.0, 2.0

_digest = xxhash.xxh64_intdigest


def fingerprint(text: str) -> int:
    """The 64-bit SimHash of one text."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return _digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -SHINGLE].tolist()]
    hashes = np.array([_digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())], dtype=np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(bits), 255):
        counts += np.add.reduce(bits[i : i + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp (the 64 bits as a signed long): one row per document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t) for t in texts_of(batch.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values.view(np.int64))], ["doc_id", "text_key", "fp"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return map_arrow(rows, work, "doc_id long, text_key long, fp long")


class Anchors:
    """The product of repetition codes over a number of blocks, and the replicas of fingerprints."""

    def __init__(self, blocks: int) -> None:
        self.blocks = blocks
        widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
        self.shifts = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(np.uint64)
        self.masks = np.array([(1 << w) - 1 for w in widths], dtype=np.uint64)
        size = 1 << max(widths)
        self.major, self.cost = np.zeros((blocks, size), dtype=np.uint64), np.zeros((blocks, size), dtype=np.int8)
        for i, w in enumerate(widths):
            ones = np.array([bin(v).count("1") for v in range(1 << w)])
            half = w // 2  # more than half: all ones; a tie: all zeros
            self.major[i, : 1 << w] = ones > half
            self.cost[i, : 1 << w] = np.where(ones > half, ones - half, half + 1 - ones)
        self.sets = [list(combinations(range(blocks), k)) for k in (1, 2, 3)]

    def expected_replicas(self) -> float:
        """Mean number of anchors of a random fingerprint."""
        counts = [1.0, 0.0, 0.0, 0.0]  # anchors by summed cost
        for i in range(self.blocks):
            costs = self.cost[i, : int(self.masks[i]) + 1]
            share = [float((costs == c).mean()) for c in (1, 2, 3)]
            counts = [counts[k] + sum(counts[k - c] * share[c - 1] for c in range(1, k + 1)) for k in range(4)]
        return sum(counts)

    def nearest(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest anchor of each fingerprint, and each block's cost."""
        parts = ((fps[:, None] >> self.shifts) & self.masks).astype(np.int64)
        rows = np.arange(self.blocks)
        anchor = np.bitwise_or.reduce(self.major[rows, parts] << rows.astype(np.uint64), axis=1)
        return anchor, self.cost[rows, parts]

    def replicas(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of arrays (anchor, place of the fingerprint), beside the nearest anchors."""
        anchor, cost = self.nearest(fps)
        for sets in self.sets:
            members = np.array(sets)
            flips = np.bitwise_or.reduce(np.uint64(1) << members.astype(np.uint64), axis=1)
            total = cost[:, members[:, 0]].copy()
            for k in range(1, members.shape[1]):
                total += cost[:, members[:, k]]
            place, which = np.nonzero(total <= THRESHOLD)
            yield anchor[place] ^ flips[which], place


def blocks_for(n: int) -> int:
    """The number of blocks with the least expected work for ``n`` distinct fingerprints."""

    def work(blocks: int) -> float:
        replicas = Anchors(blocks).expected_replicas()
        return replicas * (REPLICA_COST + COMPARE_COST * n / 2.0**blocks)

    return min(BLOCKS, key=work)


def _replicate(fps: DataFrame, blocks: int) -> DataFrame:
    """anchor, kind (0: probe, which is an index entry too; 1: index entry), fp."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(blocks)
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(every), 512):
                part = every[i : i + 512]
                found = [(anchors.nearest(part)[0], np.arange(len(part))), *anchors.replicas(part)]
                at, place = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                kind = np.ones(len(at), dtype=np.int8)
                kind[: len(part)] = 0
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(kind), pa.array(part[place].view(np.int64))], ["anchor", "kind", "fp"])

    return map_arrow(fps.select("fp"), work, "anchor long, kind byte, fp long")


def _nearest(fps: DataFrame, blocks: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(blocks)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(anchors.nearest(batch.column(0).to_numpy().view(np.uint64))[0].view(np.int64))], ["anchor"])

    return map_arrow(fps.select("fp"), work, "anchor long")


def _cells(replicas: DataFrame, hot: DataFrame) -> DataFrame:
    """anchor, cell, kind, fp. ``hot``: anchor, parts. At a hot anchor probes go to the cells of their row and index entries to those of their column."""
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    as_index = F.transform(every, lambda i: F.struct((i * F.col("parts") + own).alias("cell"), F.lit(1).cast("byte").alias("kind")))
    as_probe = F.transform(every, lambda j: F.struct((own * F.col("parts") + j).alias("cell"), F.lit(0).cast("byte").alias("kind")))
    single = F.array(F.struct(F.lit(0).alias("cell"), F.col("kind").alias("kind")))
    places = F.when(parts == 1, single).when(F.col("kind") == 1, as_index).otherwise(F.concat(as_probe, as_index))
    joined = replicas.join(hot, "anchor", "left")
    return joined.select("anchor", "fp", F.explode(places).alias("p")).select("anchor", F.col("p.cell").alias("cell"), F.col("p.kind").alias("kind"), "fp")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= THRESHOLD


class _Cell:
    """Probes of one cell, grouped once they are all there; index entries then stream past them.

    Links leave a cell as a tree over each group of linked probes, and from an index entry to one member of each group that it meets,
    taken by a hash. So no vertex gets many links from one cell, however large the group.
    """

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.probes: np.ndarray | None = None

    def grouped(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sorts the probes into groups; yields the links of a tree over each."""
        every = np.unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, np.uint64)
        groups: list[np.ndarray] = []
        left = np.arange(len(every))
        while len(left):
            front, left = left[:1], left[1:]
            group = [front]
            while len(front) and len(left):
                step, met = max(1, TILE // len(left)), np.zeros(len(left), dtype=bool)
                for i in range(0, len(front), step):
                    met |= _near(every[front[i : i + step]], every[left]).any(axis=0)
                front, left = left[met], left[~met]
                group.append(front)
            groups.append(every[np.concatenate(group)])
        self.probes = np.concatenate(groups) if groups else every  # group by group
        sizes = np.array([len(g) for g in groups], dtype=np.int64)
        self.sizes, self.begins = sizes, np.cumsum(sizes) - sizes
        self.group = np.repeat(np.arange(len(groups)), sizes)
        nth = np.arange(len(self.probes)) - self.begins[self.group]
        inner = np.flatnonzero(nth)
        if len(inner):
            yield self.probes[inner], self.probes[self.begins[self.group[inner]] + (nth[inner] - 1) // FAN]

    def passed(self, index: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of index entries, one for each group of probes that an entry meets."""
        if not len(self.probes):
            return
        for j in range(0, len(index), 4096):
            part = index[j : j + 4096]
            step = max(1, TILE // len(part))
            for i in range(0, len(self.probes), step):
                p, y = np.nonzero(_near(self.probes[i : i + step], part))
                if len(p):
                    y, group = np.unique(np.column_stack([y, self.group[i + p]]), axis=0).T
                    own = part[y]
                    member = (mix(own) % self.sizes[group].astype(np.uint64)).astype(np.int64)
                    other = self.probes[self.begins[group] + member]
                    yield own[own != other], other[own != other]


def _compare(cells: DataFrame) -> DataFrame:
    """a, b: links within each cell, from rows sorted by cell with probes first. Memory holds one cell's probes and one batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        at, cell = None, _Cell()
        for batch in batches:
            anchor, number, kind = (batch.column(i).to_numpy() for i in (0, 1, 2))
            fps = batch.column(3).to_numpy().view(np.uint64)
            bounds = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(number) != 0)) + 1
            for i, j in zip([0, *bounds.tolist()], [*bounds.tolist(), len(anchor)], strict=True):
                if i == j:
                    continue
                if at != (here := (anchor[i], number[i])):
                    if cell.probes is None:
                        yield from rows(cell.grouped())
                    at, cell = here, _Cell()
                probes = int(np.searchsorted(kind[i:j], 1))
                if probes:
                    cell.parts.append(fps[i : i + probes].copy())
                if i + probes < j:
                    if cell.probes is None:
                        yield from rows(cell.grouped())
                    yield from rows(cell.passed(fps[i + probes : j]))
        if cell.probes is None:
            yield from rows(cell.grouped())

    return map_arrow(cells, work, "a long, b long")


def near_links(fps: DataFrame, n: int | None = None, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """a, b: pairs within one component, enough to connect all distinct fingerprints within the threshold of each other (trees in each cell, not all pairs)."""
    blocks = blocks or blocks_for(fps.count() if n is None else n)
    counts = _nearest(fps, blocks).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
    hot = counts.select("anchor", F.ceil(F.col("n") / F.lit(cell)).cast("int").alias("parts"))
    cells = _cells(_replicate(fps, blocks), hot)
    spread = cells.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell", "kind")
    return _compare(spread).distinct()


def near_duplicates(docs: DataFrame, blocks: int | None = None, cell: int = CELL) -> DataFrame:
    """doc_id, text_key, fp, component_id, first (none, doc_id, text_key: that of the component's rows which comes first, ids before none): one row per document."""
    marked = cut(fingerprints(docs))
    rows = marked.count()
    tasks = tasks_for(rows)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    distinct = cut(marked.groupBy("fp").agg(F.min(own).alias("own"), F.count(F.lit(1)).alias("n")), tasks)
    labels = component_labels(near_links(distinct, blocks=blocks, cell=cell))
    of_label = labels.join(distinct.withColumnRenamed("fp", "vertex"), "vertex").groupBy("label").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n"))
    of_label = cut(of_label, tasks)
    # a component of very many fingerprints, and a fingerprint of very many documents, is dealt to many tasks
    large = hot_keys(of_label, "label", "n", labels.count())
    linked = dealt_join(labels, of_label.drop("n"), "label", large, F.xxhash64("vertex")).select(F.col("vertex").alias("fp"), "first")
    every = cut(distinct.join(linked, "fp", "left").select("fp", F.coalesce("first", "own").alias("first")), tasks)
    found = dealt_join(marked, every, "fp", hot_keys(distinct, "fp", "n", rows), F.monotonically_increasing_id())
    return found.select("doc_id", "text_key", "fp", F.col("first.doc_id").alias("component_id"), "first")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, of each component: that of the least doc_id, of rows with that id the one whose text has the least hash.

    An id does not tell documents apart: rows of one id and different texts are judged each by its own text. A row without an id is kept
    only where no row of its component has one; of rows with equal id and text, one is kept.
    """
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    keys = cut(near_duplicates(docs).groupBy("doc_id", "text_key", is_first.alias("is_first")).agg(F.count(F.lit(1)).alias("n")))
    dropped = hinted(keys.where(~F.col("is_first")).select("doc_id", "text_key"))
    kept = docs.join(dropped, _same(docs, dropped), "left_anti")
    repeated = hinted(keys.where(F.col("is_first") & (F.col("n") > 1)).select("doc_id", "text_key"))
    if repeated.isEmpty():
        return kept
    ones = kept.join(repeated, _same(kept, repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, _same(kept, repeated), "left_anti").unionByName(ones)


def _same(docs: DataFrame, keys: DataFrame) -> Column:
    """Whether a row of ``docs`` has the id and text of one of ``keys`` (id, text hash). Columns are taken from their tables, so other names cannot clash."""
    doc_id, text_key = (keys[c] for c in keys.columns)
    return docs["doc_id"].cast("long").eqNullSafe(doc_id) & (F.xxhash64(docs["text"].cast("string")) == text_key)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``documents``."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
