"""Operator 9: document quality by a factorisation machine.

Inputs are hashed words (square roots of their shares, so a text's vector has length one whatever its size), statistics of its
structure, and the table's own ``n_chars``. The machine adds to a linear score the interactions of all pairs of inputs, each by
the inner product of two low-rank vectors. By the sum-of-squares identity, sum over pairs of <v_i, v_j> x_i x_j equals half of
sum over factors of (sum v_if x_i)^2 - sum v_if^2 x_i^2, so a document is scored in time linear in its inputs.

It is fitted on at most ``SAMPLE`` labelled documents outside fold 0 (a documented bound) and scores every whole text. Null and
empty texts have no words and get the score of their statistics. With labels of one kind only, the score is a constant near
that kind. Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WordTable, fold_of, labelled_sample, map_arrow, read_table, sub_batches, texts_of

#: Labelled documents that the machine is fitted on, at most.
SAMPLE = 8_000
BUCKETS, RANK = 4096, 8
EPOCHS, BATCH, RATE, SHRINK = 12, 128, 0.05, 1e-4

_CLASSES = np.zeros(256, dtype=np.int64)  # 0: other ASCII
for _letters, _class in ((range(65, 91), 1), (range(97, 123), 2), (range(48, 58), 3), (range(128, 256), 4), (b" \t\x0b\x0c\r", 5), (b"\n", 6), (b"!?", 7), (b"|<>", 8), (b"#*$%&", 9), (b".,;:", 10)):
    _CLASSES[list(_letters)] = _class
_N_CLASSES = 16
N_STATS = 18


def measure(texts: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Statistics (rows by ``N_STATS``) and word shares (rows by ``BUCKETS``) of some texts. ``sizes``: the table's n_chars, nan if null."""
    n, table = len(texts), WordTable(texts)
    length = np.maximum(1, table.text_ends - table.text_starts)
    of_byte = np.repeat(np.arange(n), np.append(np.diff(table.text_starts), len(table.buffer) - table.text_starts[-1]))
    by_class = np.bincount(of_byte * _N_CLASSES + _CLASSES[table.buffer], minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    by_class[:-1, 6] -= 1  # the newline that the table puts between texts
    words, of_word = np.maximum(1, table.counts), np.repeat(np.arange(n), table.counts)
    hashes = table.hashes()
    shares = np.bincount(of_word * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS) / words[:, None]
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    word_bytes = (table.ends - table.starts).astype(float)
    mean = np.bincount(of_word, word_bytes, n) / words
    spread = np.sqrt(np.maximum(0, np.bincount(of_word, word_bytes**2, n) / words - mean**2))
    lines = by_class[:, 6] + 1
    stats = np.column_stack([
        np.log1p(table.counts), np.log1p(length), mean, spread, np.bincount(of_word[same], minlength=n) / words,
        shares.max(axis=1), (shares > 0).sum(axis=1) / np.minimum(words, BUCKETS), np.log1p(lines), np.log1p(length / lines),
        by_class[:, 1] / np.maximum(1, by_class[:, 1] + by_class[:, 2]), by_class[:, 3] / length, by_class[:, 4] / length, by_class[:, 7] / length,
        by_class[:, 8] / length, by_class[:, 9] / length, by_class[:, 10] / length, by_class[:, 0] / length,
        np.log1p(np.maximum(0, np.where(np.isnan(sizes), length, sizes))),
    ])
    return stats, np.sqrt(shares, dtype=np.float32, casting="unsafe")


@dataclass
class Machine:
    """Weights of a factorisation machine over standardised statistics followed by word shares."""

    centre: np.ndarray
    scale: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def inputs(self, stats: np.ndarray, shares: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((stats - self.centre) / self.scale, -4, 4).astype(np.float32) / 4, shares])

    def margin(self, x: np.ndarray) -> np.ndarray:
        pairs = ((x @ self.factors) ** 2 - (x**2) @ (self.factors**2)).sum(axis=1) / 2
        return self.bias + x @ self.linear + pairs

    def score(self, stats: np.ndarray, shares: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.inputs(stats, shares)).astype(float), -30, 30)))


def train(stats: np.ndarray, indices: list[np.ndarray], values: list[np.ndarray], y: np.ndarray) -> Machine:
    """Adaptive gradient descent on the logistic loss; shares come sparse, so only one batch is dense at a time."""
    rng = np.random.default_rng(11)
    centre, scale = (stats.mean(axis=0), stats.std(axis=0) + 1e-6) if len(y) else (np.zeros(N_STATS), np.ones(N_STATS))
    share = (y.sum() + 0.5) / (len(y) + 1)
    width = N_STATS + BUCKETS
    m = Machine(centre, scale, float(np.log(share / (1 - share))), np.zeros(width, np.float32), rng.normal(0, 0.05, (width, RANK)).astype(np.float32))
    if not len(y) or y.min() == y.max():
        m.factors[:] = 0
        return m
    seen = [1e-6, np.full(width, 1e-6, np.float32), np.full((width, RANK), 1e-6, np.float32)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            shares = np.zeros((len(rows), BUCKETS), np.float32)
            for k, r in enumerate(rows):
                shares[k, indices[r]] = values[r]
            x = m.inputs(stats[rows], shares)
            error = ((1 / (1 + np.exp(-np.clip(m.margin(x), -30, 30)))) - y[rows]).astype(np.float32) / len(rows)
            inner = x @ m.factors
            slopes = [
                float(error.sum()),
                x.T @ error + SHRINK * m.linear,
                x.T @ (error[:, None] * inner) - m.factors * ((x**2).T @ error)[:, None] + SHRINK * m.factors,
            ]
            for s, g in zip((0, 1, 2), slopes, strict=True):
                seen[s] = seen[s] + np.square(g)
            m.bias -= RATE * slopes[0] / float(np.sqrt(seen[0]))
            m.linear -= RATE * slopes[1] / np.sqrt(seen[1])
            m.factors -= RATE * slopes[2] / np.sqrt(seen[2])
    return m


def _measured(batch: pa.RecordBatch, text: int, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data = [t.encode("utf-8", "replace") for t in texts_of(batch.column(text))]
    sizes = batch.column(size).cast(pa.float64()).to_numpy(zero_copy_only=False)
    for a, b in sub_batches(data, 1 << 20):
        for i in range(a, b, 256):
            j = min(b, i + 256)
            yield i, j, *measure(data[i:j], sizes[i:j])


def _size(docs: DataFrame):
    return (F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")).alias("n_chars")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Machine:
    """The machine fitted on a bounded labelled sample; only that sample's inputs reach the driver, as sparse rows."""
    rows = labelled_sample(docs, labels, label, SAMPLE, (_size(docs),)).select("n_chars", "text", "label")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels_of = batch.column(2).to_pylist()
            for i, j, stats, shares in _measured(batch, 1, 0):
                held = [np.flatnonzero(s) for s in shares]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(labels_of[i:j], pa.int32()), pa.array(list(stats), pa.list_(pa.float64())), pa.array([h.astype("<u2").tobytes() for h in held], pa.binary()),
                     pa.array([s[h].astype("<f4").tobytes() for s, h in zip(shares, held, strict=True)], pa.binary())],
                    ["label", "stats", "at", "value"],
                )

    # in the order of a hash of the content, so that the fit does not depend on partitions
    got = sorted(map_arrow(rows, work, "label int, stats array<double>, at binary, value binary").collect(), key=lambda r: (bytes(r.at), r.stats))
    stats = np.array([r.stats for r in got]).reshape(-1, N_STATS)
    return train(stats, [np.frombuffer(r.at, "<u2") for r in got], [np.frombuffer(r.value, "<f4") for r in got], np.array([r.label > 0 for r in got], dtype=np.float32))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score: one row per document."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, stats, shares in _measured(batch, 1, 2):
                out[i:j] = machine.score(stats, shares)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _size(docs)), work, "doc_id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: fitted outside fold 0, then every document scored."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
