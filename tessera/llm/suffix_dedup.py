"""Operator 8: bytes covered by a ``WINDOW``-byte string that starts in another place too, by suffix arrays over parts of the corpus.

A suffix array of the whole corpus would have to move every suffix. Instead strings are brought together by anchors: the anchor of
a string is the ``GRAM``-byte piece of least hash in it (the leftmost of equals), which depends on the string alone. The strings of a
document that share an anchor place form one segment, the piece of text that they cover. So equal strings lie in segments with
equal anchors, at equal places.

(1) Groups of documents report anchor and content hash of their segments. An anchor with one segment holds no repeat; a content that
occurs twice or more is repeated as a whole, whatever the number of its copies. (2) Where different contents share an anchor, each
content is sent once to the task of that anchor, which sorts the suffixes of such contents by two-stage sorting (module
``suffix_array``) and finds the strings whose common prefix with a neighbour in that order has ``WINDOW`` bytes. Anchors with more than ``HOT``
contents, as a phrase of a third of all documents has, would sort in one task what no task can hold; their strings go to tasks by
their hash instead, each group reporting a string once, and equal strings meet there. That is another way to the same rows, tested against brute force
with ``hot`` from 2 up. (3) Documents lose what their repeated strings cover.

Contents and strings are told apart by 64-bit hashes. Strings are judged on the input. Null text is empty; doc_id takes no part in
the matching, so repeated rows are repeats of each other and a null id is one like any other. Other columns are ignored; an empty
table gives no rows. Memory: a group of ``groups.GROUP_BYTES`` or its longest text (in parts of 1 MB), at some 60 bytes for each byte of a part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import _BYTE_CODE, map_arrow, mix, powers, prefix_hash, read_table, span_hash, sub_batches
from tessera.llm.groups import deal, found_in, pack_plain, texts_and_ids, unpack_plain
from tessera.llm.suffix_array import repeated_windows

WINDOW, GRAM = 400, 128
#: Contents of one anchor that go to one suffix array at most, and bytes of text that it is made of (whole anchors, so a little more).
HOT, BATCH = 256, 1 << 20
#: Bytes of text whose segments' keys, or split strings' hashes at most, meet in one bucket.
SEGMENT_BYTES, SPLIT_BYTES = 128 << 20, 8 << 20
#: Low bits of a gram's hash that give way to its place: texts of up to 4 GB, more than an Arrow string holds.
_PLACE = np.uint64((1 << 32) - 1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima within blocks in both directions."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Segments:
    """The segments of some texts: spans of ``raw``, hash of the anchor, hash of the content, text and first string of each."""

    def __init__(self, texts: list[bytes], window: int, gram: int) -> None:
        self.window, self.raw = window, b"".join(texts)
        n = len(self.raw)
        self.ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        self.begins = self.ends - np.array([len(t) for t in texts], dtype=np.int64)
        self.prefix = prefix_hash(_BYTE_CODE[np.frombuffer(self.raw, dtype=np.uint8)])
        grams = max(0, n - gram + 1)
        hashes = mix((self.prefix[gram:] - self.prefix[:grams]) * powers(n + 1)[1][:grams]) if grams else np.zeros(0, np.uint64)
        least = sliding_least((hashes & ~_PLACE) | np.arange(grams, dtype=np.uint64), window - gram + 1) & _PLACE
        marks = np.zeros(n + 2, dtype=np.int64)
        long = self.ends - self.begins >= window
        np.add.at(marks, self.begins[long], 1)
        np.add.at(marks, self.ends[long] - window + 1, -1)
        self.starts = np.flatnonzero(np.cumsum(marks)[:-1] > 0)  # of strings that lie in one text
        anchor = least[self.starts].astype(np.int64)
        new = np.ones(len(self.starts), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(self.starts) != 1)
        self.first = np.flatnonzero(new)  # of each segment's strings, in ``starts``
        self.last = np.append(self.first[1:], len(self.starts))
        self.begin, self.end = self.starts[self.first], self.starts[self.last - 1] + window if len(self.first) else self.first
        self.anchor = mix(hashes[anchor[self.first]])
        self.content = mix(span_hash(self.prefix, self.begin, self.end) + (self.end - self.begin).astype(np.uint64))

    def strings(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``starts`` and hashes of all strings of some segments."""
        counts = self.last[segments] - self.first[segments]
        at = np.repeat(self.first[segments] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        begin = self.starts[at]
        return at, mix(span_hash(self.prefix, begin, begin + self.window))


def _parts(table: pa.Table, window: int, gram: int) -> Iterator[tuple[int, int, list[bytes], Segments]]:
    texts = texts_and_ids(table)[0]
    for i, j in sub_batches(texts, 1 << 20):
        yield i, j, texts[i:j], Segments(texts[i:j], window, gram)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    bounds = np.flatnonzero(np.diff(sorted_values.astype(np.int64), prepend=-1, append=-1)) if len(sorted_values) else []
    yield from zip(bounds[:-1], bounds[1:], strict=True)


_ASKED = pa.schema([("g", pa.int32()), ("bucket", pa.int32()), ("anchors", pa.binary()), ("contents", pa.binary()), ("numbers", pa.binary())])
_ASKED_DDL = "g int, bucket int, anchors binary, contents binary, numbers binary"


def _ask(window: int, gram: int, buckets: int):
    def ask(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        pairs = [np.column_stack([s.anchor, s.content]) for _, _, _, s in _parts(table, window, gram)]
        anchor, content = np.concatenate(pairs).T if pairs else np.zeros((2, 0), np.uint64)
        bucket = anchor % np.uint64(buckets)
        order = np.lexsort((content, anchor, bucket))
        anchor, content, bucket = anchor[order], content[order], bucket[order]
        new = np.ones(len(anchor), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        at = np.flatnonzero(new)
        numbers = np.minimum(np.diff(at, append=len(anchor)), 2).astype(np.uint8)
        anchor, content, bucket = anchor[at], content[at], bucket[at]
        return _table(_ASKED, [(g, int(bucket[i]), pack_plain(anchor[i:j]), pack_plain(content[i:j]), numbers[i:j].tobytes()) for i, j in _runs(bucket)])

    return ask


#: What a group is told about a content: it is repeated as a whole; the group is to send it; its anchor is split.
FULL, SEND, SPLIT = 1, 2, 4
_TOLD = pa.schema([("g", pa.int32()), ("contents", pa.binary()), ("flags", pa.binary())])
_TOLD_DDL = "g int, contents binary, flags binary"


def _answer(hot: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
        for _, own in groupby(rows, key=lambda r: r[1]):
            blocks = list(own)
            anchor, content = (np.concatenate([unpack_plain(r[k], np.uint64) for r in blocks]) for k in (2, 3))
            number = np.concatenate([np.frombuffer(r[4], np.uint8) for r in blocks]).astype(np.int64)
            order = np.lexsort((content, anchor))  # stable: a content's first group comes first
            a, c = anchor[order], content[order]
            new_anchor = np.ones(len(a), dtype=bool)
            new_anchor[1:] = a[1:] != a[:-1]
            new = new_anchor.copy()
            new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            copies = np.repeat(np.add.reduceat(number[order], at), np.diff(at, append=len(a)))
            of_anchor = np.flatnonzero(new_anchor)
            kinds = np.repeat(np.add.reduceat(new.astype(np.int64), of_anchor), np.diff(of_anchor, append=len(a)))
            sent = (kinds > 1) & new
            flags = np.empty(len(a), dtype=np.uint8)
            flags[order] = FULL * (copies > 1) + SEND * sent + SPLIT * (sent & (kinds > hot))
            done = 0
            for r in blocks:
                n = len(r[4])
                told = np.flatnonzero(flags[done : done + n]) + done
                if len(told):
                    yield _table(_TOLD, [(r[0], pack_plain(content[told]), flags[told].tobytes())]).to_batches()[0]
                done += n

    return answer


#: Rows to the sorting tasks and back. Kind 0: contents repeated as a whole. Kind 1: a content, back as the places of its repeated strings
#: (one bit each). Kind 2: strings of split anchors (hashes, and whether a group has one twice), back as those repeated.
_MOVED = pa.schema([("g", pa.int32()), ("kind", pa.int8()), ("key", pa.int64()), ("content", pa.int64()), ("full", pa.bool_()), ("data", pa.binary()), ("more", pa.binary())])
_MOVED_DDL = "g int, kind byte, key long, content long, full boolean, data binary, more binary"


def _told(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Contents that a group was told of, sorted, and their flags."""
    contents = np.concatenate([np.zeros(0, np.uint64), *[unpack_plain(x.as_py(), np.uint64) for x in answers.column("contents")]])
    flags = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(x.as_py(), np.uint8) for x in answers.column("flags")]])
    order = np.argsort(contents, kind="stable")
    return contents[order], flags[order]


def _send(window: int, gram: int, buckets: int):
    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _MOVED.empty_table()
        g = table.column("g")[0].as_py()
        known, flags = _told(answers)
        rows = [(g, 0, g, 0, True, pack_plain(known[(flags & FULL) > 0]), b"")]
        done, hashes, twice = np.zeros(len(known), dtype=bool), [], []
        for _, _, _, s in _parts(table, window, gram):
            there, at = found_in(known, s.content)
            wanted = np.flatnonzero(there & ((flags[at] & SEND) > 0) & ~done[at])
            wanted = wanted[np.unique(at[wanted], return_index=True)[1]]  # each content once
            done[at[wanted]] = True
            split = (flags[at[wanted]] & SPLIT) > 0
            for i, full in zip(wanted[~split].tolist(), ((flags[at[wanted[~split]]] & FULL) > 0).tolist(), strict=True):
                rows.append((g, 1, int(s.anchor[i].view(np.int64)), int(s.content[i].view(np.int64)), full, s.raw[s.begin[i] : s.end[i]], b""))
            if split.any():
                own = wanted[split]
                hashes.append(s.strings(own)[1])
                twice.append(np.repeat((flags[at[own]] & FULL) > 0, s.last[own] - s.first[own]))
        if hashes:
            h, t = np.concatenate(hashes), np.concatenate(twice)
            bucket = (h >> np.uint64(40)) % np.uint64(buckets)
            order = np.lexsort((h, bucket))
            h, t, bucket = h[order], t[order], bucket[order]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            t = np.maximum.reduceat(t, at) | (np.diff(at, append=len(h)) > 1)
            h, bucket = h[at], bucket[at]
            rows += [(g, 2, int(bucket[i]), 0, False, pack_plain(h[i:j]), t[i:j].astype(np.uint8).tobytes()) for i, j in _runs(bucket)]
        return _table(_MOVED, rows)

    return send


def _sort(window: int):
    def results(pieces: dict[str, list]) -> Iterator[pa.RecordBatch]:
        out = []
        for g, content, full, found in zip(pieces["g"], pieces["content"], pieces["full"], repeated_windows(pieces["data"], window), strict=True):
            if not full and found.any():
                out.append((g, 1, 0, content, False, np.packbits(found).tobytes(), b""))
        if out:
            yield _table(_MOVED, out).to_batches()[0]

    def counted(blocks: list[tuple]) -> Iterator[pa.RecordBatch]:
        every = [unpack_plain(b[5], np.uint64) for b in blocks]
        number = np.concatenate([np.frombuffer(b[6], np.uint8) for b in blocks]).astype(np.int64) + 1
        distinct, of = np.unique(np.concatenate(every), return_inverse=True)
        repeated = np.bincount(of, number)[of] > 1
        done = 0
        for b, h in zip(blocks, every, strict=True):
            own = h[repeated[done : done + len(h)]]
            done += len(h)
            if len(own):
                yield _table(_MOVED, [(b[0], 2, 0, 0, False, pack_plain(own), b"")]).to_batches()[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = lambda: {"g": [], "content": [], "full": [], "data": []}
        pieces, size, anchor = empty(), 0, None
        blocks: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = tuple(c[i].as_py() for c in batch.columns)
                kind = row[1]
                if kind == 0:
                    yield _table(_MOVED, [row]).to_batches()[0]
                elif kind == 1:
                    if size > BATCH and row[2] != anchor:
                        yield from results(pieces)
                        pieces, size = empty(), 0
                    anchor, size = row[2], size + len(row[5])
                    for name, value in (("g", row[0]), ("content", row[3]), ("full", row[4]), ("data", row[5])):
                        pieces[name].append(value)
                else:
                    if blocks and blocks[0][2] != row[2]:
                        yield from counted(blocks)
                        blocks = []
                    blocks.append(row)
        if pieces["g"]:
            yield from results(pieces)
        if blocks:
            yield from counted(blocks)

    return work


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _remove(window: int, gram: int):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _OUT.empty_table()
        kinds = answers.column("kind").to_pylist()
        data = answers.column("data").to_pylist()
        nothing = np.zeros(0, np.uint64)
        full = np.unique(np.concatenate([nothing, *[unpack_plain(d, np.uint64) for k, d in zip(kinds, data, strict=True) if k == 0]]))
        single = np.unique(np.concatenate([nothing, *[unpack_plain(d, np.uint64) for k, d in zip(kinds, data, strict=True) if k == 2]]))
        bits = {np.int64(c).view(np.uint64): d for k, c, d in zip(kinds, answers.column("content").to_pylist(), data, strict=True) if k == 1}
        partly = np.sort(np.array(list(bits), dtype=np.uint64))
        sizes, removed, spans, kept = [], [], [], []
        for _, _, texts, s in _parts(table, window, gram):
            lost = np.zeros(len(s.starts), dtype=bool)
            whole = found_in(full, s.content)[0]
            lost[np.repeat(whole, s.last - s.first)] = True
            for i in np.flatnonzero(found_in(partly, s.content)[0] & ~whole).tolist():
                a, b = s.first[i], s.last[i]
                lost[a:b] = np.unpackbits(np.frombuffer(bits[s.content[i]], np.uint8), count=b - a).astype(bool)
            if len(single):
                lost |= found_in(single, mix(span_hash(s.prefix, s.starts, s.starts + window)))[0]
            steps = np.zeros(len(s.raw) + window + 1, dtype=np.int32)
            at = s.starts[lost]
            steps[at] += 1
            np.subtract.at(steps, at + window, 1)
            gone = np.cumsum(steps)[: len(s.raw)] > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            raw = np.frombuffer(s.raw, np.uint8)
            for text, a, b in zip(texts, s.begins.tolist(), s.ends.tolist(), strict=True):
                n = int(sums[b] - sums[a])
                own = gone[a:b]
                sizes.append(b - a)
                removed.append(n)
                spans.append(int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if n else 0)
                kept.append(raw[a:b][~own].tobytes() if n else text)
        columns = [table.column("doc_id").combine_chunks(), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(kept, pa.binary())]
        return pa.Table.from_arrays(columns, schema=_OUT)

    return remove


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay): one row per document."""
    dealt = deal(docs)
    buckets, split_buckets = dealt.buckets(SEGMENT_BYTES), dealt.buckets(SPLIT_BYTES)
    by_group = dealt.rows.groupBy("g")
    asked = by_group.applyInArrow(_ask(window, gram, buckets), _ASKED_DDL)
    told = map_arrow(dealt.by_bucket(asked, buckets, "g"), _answer(hot), _TOLD_DDL)
    sent = by_group.cogroup(told.groupBy("g")).applyInArrow(_send(window, gram, split_buckets), _MOVED_DDL)
    # buckets of split strings are many rows each, so they are dealt in turn; keys of the other kinds by hash
    turn = F.when(F.col("kind") == 2, F.col("key")).otherwise(F.xxhash64("key"))
    spread = sent.repartitionById(dealt.parts, F.pmod(turn, F.lit(dealt.parts)).cast("int"))
    found = map_arrow(spread.sortWithinPartitions("kind", "key", "g"), _sort(window), _MOVED_DDL)
    return by_group.cogroup(found.groupBy("g")).applyInArrow(_remove(window, gram), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``documents``."""
    found = remove_repeated_bytes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: The same rows for an SQL engine (ids unique and not null).
OP8_SQL = """
with docs as (select doc_id, encode(coalesce(text, '')) as b from documents),
  strings as (select doc_id, i, md5(array_slice(b, i, i + 399)) as h from (select doc_id, b, unnest(generate_series(1, octet_length(b) - 399)) as i from docs)),
  repeated as (select doc_id, i from (select doc_id, i, count(*) over (partition by h) as n from strings) where n > 1),
  marked as (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 400 then 0 else 1 end as new from repeated),
  runs as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from marked),
  spans as (select doc_id, run, min(i) as a, max(i) + 399 as z from runs group by doc_id, run),
  ends as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from spans
    union all select doc_id, octet_length(b) + 1, null, coalesce((select max(z) from spans s where s.doc_id = d.doc_id), 0) from docs d),
  kept as (select e.doc_id, sha256(unhex(coalesce(string_agg(case when a - 1 > before then hex(array_slice(b, before + 1, a - 1)) else '' end, '' order by a), ''))) as kept_sha256
    from ends e join docs using (doc_id) group by e.doc_id)
select doc_id, cast(octet_length(b) as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, kept_sha256
from docs join kept using (doc_id) left join (select doc_id, sum(z - a + 1) as n_removed, count(*) as n_spans from spans group by doc_id) using (doc_id)
"""
