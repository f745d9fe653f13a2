"""Operator 6: words covered by a ``WINDOW``-word passage that starts in an earlier document, found by fixed-block anchors.

A passage of ``WINDOW`` words holds at least one whole block of ``BLOCK`` words of any document that has it, where blocks are those at
multiples of ``BLOCK``. So (1) every document's blocks are indexed and every rolling ``BLOCK``-word window of every document
probes the index; (2) each hit is extended to both sides, word by word, as long as the ``WINDOW``-word windows that hold a hit have an
earlier owner, the least doc_id among all documents; (3) runs of such windows are the maximal exact repeats, and a document loses
their words. Windows without a hit are never looked at: no repeat can lie there. Extending by windows rather than by pairs of documents gives the
union of all partners' repeats without ever forming a pair.

Candidates are compared by 64-bit hashes with more bits in the choice of bucket; block hits by fewer bits, since a false hit only
makes candidates. A passage that a third of all documents have is one entry for each group of documents, at each step.

Windows are judged on the input. Equal doc_ids are not earlier than each other, and a null doc_id is never earlier and loses nothing.
Null text has no words. Repeated rows give repeated rows; other columns are ignored; an empty table gives no rows. Memory: a group
of ``groups.GROUP_BYTES`` or its longest text, at some 60 bytes for each byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WordTable, map_arrow, mix, prefix_hash, read_table, span_hash
from tessera.llm.groups import deal, found_in, pack, pack_plain, texts_and_ids, unpack, unpack_plain

WINDOW, BLOCK = 50, 25
#: Bytes of text whose keys meet in one bucket: of the index (a 25th of the rolling windows, which stream past it), and of candidate windows.
INDEX_BYTES, CANDIDATE_BYTES = 1 << 30, 16 << 20
_ASKED = pa.schema([("g", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int8()), ("keys", pa.binary()), ("ids", pa.binary())])
_ASKED_DDL = "g int, bucket int, kind byte, keys binary, ids binary"


class Passages:
    """The words of one group of documents and hashes of their windows. Documents are in an order that depends on them alone, so places in one phase are those of the next."""

    def __init__(self, table: pa.Table) -> None:
        texts, ids, known = texts_and_ids(table)
        order = sorted(range(len(texts)), key=list(zip(known.tolist(), ids.tolist(), texts, strict=True)).__getitem__)
        self.texts, self.ids, self.known = [texts[i] for i in order], ids[order], known[order]
        self.words = WordTable(self.texts)
        self.of_word = np.repeat(np.arange(len(self.texts)), self.words.counts)
        hashes = self.words.hashes()
        self.prefix, self.second = prefix_hash(hashes), prefix_hash(mix(hashes + np.uint64(0x51)))
        room = self.words.last[self.of_word] - np.arange(len(self.of_word))
        usable = (self.known & (self.words.counts >= WINDOW))[self.of_word]
        self.blocks_at = np.flatnonzero(usable & (room >= BLOCK))  # where a rolling block may start
        self.windows_at = np.flatnonzero(usable & (room >= WINDOW))

    def block_keys(self, buckets: int) -> np.ndarray:
        """bucket << 32 | 32 bits, for each of ``blocks_at``."""
        h = mix(span_hash(self.prefix, self.blocks_at, self.blocks_at + BLOCK))
        return (h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(32) | h >> np.uint64(32)

    def is_fixed(self) -> np.ndarray:
        """Which of ``blocks_at`` are fixed blocks of their document."""
        return (self.blocks_at - self.words.first[self.of_word[self.blocks_at]]) % BLOCK == 0

    def window_keys(self, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and bucket of the windows at some places."""
        spread = mix(span_hash(self.second, at, at + WINDOW)) % np.uint64(buckets)
        return mix(span_hash(self.prefix, at, at + WINDOW)), spread


def _blocks(g: int, kind: int, keys: np.ndarray) -> Iterator[tuple]:
    """Rows of packed keys (sorted, bucket in the high half), one for each bucket."""
    bucket = (keys >> np.uint64(32)).astype(np.int64)
    bounds = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(keys) else []
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        yield g, int(bucket[i]), kind, pack((keys[i:j] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), b""


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ASKED)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ASKED, strict=True)], schema=_ASKED)


def _ask_blocks(buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        g, found = table.column("g")[0].as_py(), Passages(table)
        keys = found.block_keys(buckets)
        return _table([*_blocks(g, 0, np.unique(keys[found.is_fixed()])), *_blocks(g, 1, np.unique(keys))])

    return ask


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows (g, kind, keys, ids) of each bucket, from rows sorted by bucket."""
    from itertools import groupby

    rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
    for bucket, own in groupby(rows, key=lambda r: r[1]):
        yield bucket, ((r[0], r[2], r[3], r[4]) for r in own)


def _answer_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group, the keys it shares with another group where one of the two has them as a fixed block."""
    for bucket, rows in _by_bucket(batches):
        fixed: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        index = owner = hit = None
        for g, kind, packed, _ in rows:
            keys = unpack(packed, np.uint32)
            if kind == 0:
                fixed.append(keys)
                owners.append(np.full(len(keys), g, dtype=np.int32))
                continue
            if index is None:
                every, of = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (fixed, owners))
                order = np.argsort(every, kind="stable")
                index, at, n = np.unique(every[order], return_index=True, return_counts=True)
                owner = np.where(n > 1, -1, of[order][at]) if len(index) else np.zeros(0, np.int32)
                hit = np.zeros(len(index), dtype=bool)
                fixed, owners = [], []
            there, at = found_in(index, keys)
            shared = there & (owner[at] != g) if len(index) else there
            if shared.any():
                hit[at[shared]] = True
                yield _table([(g, bucket, 0, pack(keys[shared]), b"")]).to_batches()[0]
        if hit is not None:
            hit &= owner >= 0
            for g in np.unique(owner[hit]):
                yield _table([(int(g), bucket, 0, pack(index[hit & (owner == g)]), b"")]).to_batches()[0]


def _ask_windows(buckets: int, window_buckets: int):
    """The windows that hold a hit, by bucket; and for the group itself (kind 1) which of its windows those are, one bit each."""

    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([])
        g, found = table.column("g")[0].as_py(), Passages(table)
        keys = found.block_keys(buckets)
        told = [unpack(k.as_py(), np.uint32).astype(np.uint64) | np.uint64(b.as_py() << 32) for b, k in zip(answers.column("bucket"), answers.column("keys"), strict=True)]
        # what two places of this group share needs no answer
        own, n = np.unique(keys, return_counts=True)
        told.append(np.intersect1d(own[n > 1], keys[found.is_fixed()]))
        hits = np.zeros(len(found.of_word) + BLOCK + 2, dtype=np.int64)
        hits[found.blocks_at + 1] = found_in(np.unique(np.concatenate(told)), keys)[0]
        sums = np.cumsum(hits)
        near_hit = sums[found.windows_at + WINDOW - BLOCK + 1] > sums[found.windows_at]
        at = found.windows_at[near_hit]
        if not len(at):
            return _table([])
        h, bucket = found.window_keys(at, window_buckets)
        order = np.lexsort((found.ids[found.of_word[at]], h, bucket))
        h, bucket, ids = h[order], bucket[order], found.ids[found.of_word[at]][order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])
        h, bucket, ids = h[first], bucket[first].astype(np.int64), ids[first]
        bounds = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        rows = [(g, int(bucket[i]), 0, pack(h[i:j]), pack_plain(ids[i:j])) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        return _table([*rows, (g, g % window_buckets, 1, np.packbits(near_hit).tobytes(), b"")])

    return ask


def _answer_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group, the windows that an earlier document of another group has; rows of kind 1 pass."""
    for bucket, rows in _by_bucket(batches):
        groups, hashes, ids = [], [], []
        for g, kind, packed, first in rows:
            if kind == 1:
                yield _table([(g, bucket, 1, packed, b"")]).to_batches()[0]
                continue
            groups.append(g)
            hashes.append(unpack(packed, np.uint64))
            ids.append(unpack_plain(first, np.int64))
        if not groups:
            continue
        every, least = np.concatenate(hashes), np.concatenate(ids)
        order = np.argsort(every, kind="stable")
        distinct, at = np.unique(every[order], return_index=True)
        least = np.minimum.reduceat(least[order], at)
        for g, own, first in zip(groups, hashes, ids, strict=True):
            lost = least[np.searchsorted(distinct, own)] < first
            if lost.any():
                yield _table([(g, bucket, 0, pack(own[lost]), b"")]).to_batches()[0]


_SPAN = pa.struct([("first", pa.int32()), ("words", pa.int32())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("repeats", pa.list_(_SPAN))])
_OUT_DDL = "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<first:int,words:int>>"


def _extended(found: Passages, answers: pa.Table, buckets: int) -> np.ndarray:
    """Places of the windows around hits that have an earlier owner, in this group or, by the answers, in another."""
    rows = list(zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "keys")), strict=True))
    near_hit = next((np.unpackbits(np.frombuffer(keys, np.uint8), count=len(found.windows_at)).astype(bool) for kind, _, keys in rows if kind == 1), None)
    if near_hit is None:
        return found.windows_at[:0]
    at = found.windows_at[near_hit]
    h, bucket = found.window_keys(at, buckets)
    ids = found.ids[found.of_word[at]]
    order = np.lexsort((ids, h, bucket))
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
    least = np.empty(len(h), dtype=np.int64)
    least[order] = ids[order][np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))]
    lost = ids > least
    told = [(b, keys) for kind, b, keys in rows if kind == 0]
    bounds = np.searchsorted(bucket[order], np.array([[b, b + 1] for b, _ in told], dtype=np.uint64).reshape(-1, 2))
    for (i, j), (_, keys) in zip(bounds.tolist(), told, strict=True):
        own = order[i:j]
        lost[own] |= found_in(unpack(keys, np.uint64), h[own])[0]
    return at[lost]


def _remove(buckets: int):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _OUT.empty_table()
        found = Passages(table)
        lost = _extended(found, answers, buckets)
        steps = np.zeros(len(found.of_word) + WINDOW + 1, dtype=np.int64)
        steps[lost] += 1
        np.subtract.at(steps, lost + WINDOW, 1)
        gone = np.cumsum(steps)[: len(found.of_word)] > 0
        removed = np.bincount(found.of_word[gone], minlength=len(found.texts))
        # a run of windows, one word apart in one document, is one maximal repeat
        new = np.ones(len(lost), dtype=bool)
        new[1:] = (np.diff(lost) != 1) | (found.of_word[lost][1:] != found.of_word[lost][:-1])
        begin = np.flatnonzero(new)
        size = np.diff(begin, append=len(lost)) + WINDOW - 1
        owner = found.of_word[lost[begin]]
        raw, w = found.words.raw, found.words
        kept = []
        for d, n in enumerate(removed):
            i, j = w.first[d], w.last[d]
            if n:
                stay = np.flatnonzero(~gone[i:j]) + i
                kept.append(b" ".join([raw[a:b] for a, b in zip(w.starts[stay].tolist(), w.ends[stay].tolist(), strict=True)]))
            else:
                kept.append(b" ".join(found.texts[d].split()))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(found.texts)))]).astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array((lost[begin] - w.first[owner]).astype(np.int32)), pa.array(size.astype(np.int32))], fields=list(_SPAN))
        columns = [
            pa.array(found.ids, pa.int64(), mask=~found.known), pa.array(w.counts.astype(np.int64)), pa.array(removed.astype(np.int64)),
            pa.array(kept, pa.binary()).cast(pa.string()), pa.ListArray.from_arrays(pa.array(offsets), spans),
        ]
        return pa.Table.from_arrays(columns, schema=_OUT)

    return remove


def remove_repeats(docs: DataFrame, index_bytes: int = INDEX_BYTES, candidate_bytes: int = CANDIDATE_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a blank), repeats (first word and number of words of each maximal repeat): one row per document."""
    dealt = deal(docs)
    buckets, window_buckets = dealt.buckets(index_bytes), dealt.buckets(candidate_bytes)
    by_group = dealt.rows.groupBy("g")
    asked = by_group.applyInArrow(_ask_blocks(buckets), _ASKED_DDL)
    answers = map_arrow(dealt.by_bucket(asked, buckets, "kind", "g"), _answer_blocks, _ASKED_DDL)
    windows = by_group.cogroup(answers.groupBy("g")).applyInArrow(_ask_windows(buckets, window_buckets), _ASKED_DDL)
    lost = map_arrow(dealt.by_bucket(windows, window_buckets, "g"), _answer_windows, _ASKED_DDL)
    return by_group.cogroup(lost.groupBy("g")).applyInArrow(_remove(window_buckets), _OUT_DDL)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``documents``."""
    found = remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows for an SQL engine (ids unique and not null).
OP6_SQL = r"""
with docs as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
  windows as (select doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) as w from (select doc_id, words, unnest(generate_series(1, len(words) - 49)) as i from docs)),
  lost as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by w) as least from windows) where least < doc_id),
  gone as (select doc_id, list(distinct i + j) as places from lost, generate_series(0, 49) g(j) group by doc_id)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(len(places), 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(list_filter(words, lambda w, i: places is null or not list_contains(places, i)), ' '), '')) as kept_sha256
from docs left join gone using (doc_id)
"""
