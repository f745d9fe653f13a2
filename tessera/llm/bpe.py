"""Operator 10: byte-level BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

Sufficient lookahead. Let rules be applied in rank order to a text and to the same text cut at some position. The two
token sequences first differ at the cut; rule (a, b) can move the first difference leftward only by joining the token ``a``
that ends there, thus by ``len(a)`` bytes, and a later rule (c, d) can move it on only if ``d`` was built from the left out
of ``a``. The longest such chain of rules of rising rank bounds how far the cut can be felt; :func:`lookahead` computes it
from the merge list. A token that ends at least that many bytes before the end of what has been read is stable: it is emitted,
and encoding starts again behind it (what follows a token boundary encodes as if it stood alone). So the encoder holds one
window of bytes, however long a pre-token is.

Null and empty texts have no tokens; the decoded text is then empty. Repeated rows give repeated rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, read_table, texts_of

#: The pre-token pattern of byte-level BPE as published with GPT-2 (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NONE = 1 << 30


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file (a public rule)."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary is; callers may pass any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """The merge list as numbers: ranks by pair of ids, results by rank, and the bytes of each id."""

    def __init__(self, definition: str) -> None:
        data = json.loads(definition)
        vocabulary: dict[str, int] = data["model"]["vocab"]
        code = {letter: b for b, letter in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        top = max([*vocabulary.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * (top + 1)
        for token, i in vocabulary.items():
            if token not in self.special:
                self.token_bytes[i] = bytes(code[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_ids = [vocabulary[letter] for letter in byte_letters()]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.rules = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]
        self.rank = {a << 32 | b: r for r, (a, b, _) in reversed(list(enumerate(self.rules)))}
        self.result = [c for _, _, c in self.rules]


def lookahead(merges: Merges) -> int:
    """Bytes of lookahead that suffice for a token to be stable (see the module's docstring)."""
    left: dict[int, int] = {}  # the left part of each merged token, by the rule of least rank
    moved: dict[int, int] = {}  # the farthest that a chain ending in a rule with this left part has moved
    most = 0
    for a, b, c in merges.rules:
        reach, spine = 0, b
        while spine is not None:
            reach = max(reach, moved.get(spine, 0))
            spine = left.get(spine)
        moved[a] = max(moved.get(a, 0), reach + len(merges.token_bytes[a]))
        most = max(most, moved[a])
        left.setdefault(c, a)
    return most


class StreamingEncoder:
    """Text in, token ids out (packed as little-endian 32-bit integers), with a window of constant size.

    ``cache_size`` bounds the memory of pre-tokens seen; it holds whole pre-tokens of up to 64 characters only.
    """

    def __init__(self, merges: Merges, cache_size: int = 200_000, block: int = 512) -> None:
        self.merges, self.ahead = merges, lookahead(merges)
        # a window must let at least its first token out, however long the vocabulary's tokens are
        self.window = self.ahead + max(block, *map(len, merges.token_bytes))
        self.cache = _Cache(self, cache_size)
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, merges.special)) + ")") if merges.special else None

    def _merge(self, data: bytes) -> list[int]:
        """All rules over one window: the pair of least rank first, the leftmost of equals."""
        ids, rank, result = self.merges.byte_ids, self.merges.rank.get, self.merges.result
        tokens = [ids[b] for b in data]
        ranks = [rank(a << 32 | b, _NONE) for a, b in zip(tokens, tokens[1:])]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            tokens[i] = result[least]
            del tokens[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(tokens[i - 1] << 32 | tokens[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(tokens[i] << 32 | tokens[i + 1], _NONE)
        return tokens

    def transduce(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one pre-token given in chunks, each emitted once it is stable."""
        held = b""
        for chunk in chunks:
            held += chunk
            while len(held) > self.window:
                part = held[: self.window]
                done = 0
                for token in self._merge(part):
                    size = len(self.merges.token_bytes[token])
                    if done + size > self.window - self.ahead:
                        break
                    yield token
                    done += size
                held = held[done:]
        yield from self._merge(held)

    def pre_token(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "replace")
        if len(data) <= self.window:  # as :meth:`transduce` does with what one window holds
            tokens = self._merge(data)
            return pack(f"<{len(tokens)}I", *tokens)
        step = self.window
        chunks = (data[i : i + step] for i in range(0, len(data), step))
        return np.fromiter(self.transduce(chunks), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text. A special token's string is that token."""
        get = self.cache.__getitem__
        if self.special is None or not any(s in text for s in self.merges.special):
            return b"".join(map(get, self.split(text)))
        out = []
        for part in self.special.split(text):
            if part in self.merges.special:
                out.append(np.array([self.merges.special[part]], dtype="<u4").tobytes())
            else:
                out.extend(map(get, self.split(part)))
        return b"".join(out)


class _Cache(dict):
    """Pre-token -> packed ids in two generations of bounded size: when the young one is full it becomes the old one, whose entries come back as they are met."""

    def __init__(self, encoder: StreamingEncoder, size: int) -> None:
        super().__init__()
        self.encoder, self.size = encoder, size // 2
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = self.encoder.pre_token(piece)
        if len(piece) <= 64:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class StreamingDecoder:
    """Ids in, text out: bytes pass an incremental UTF-8 state machine that holds at most an unfinished character."""

    def __init__(self, merges: Merges) -> None:
        self.piece = merges.token_bytes.__getitem__
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.piece, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


def decode(merges: Merges, packed: bytes, step: int = 8192) -> Iterator[str]:
    """The text of packed ids, piece by piece."""
    ids, decoder = np.frombuffer(packed, dtype="<u4"), StreamingDecoder(merges)
    for i in range(0, len(ids), step):
        yield decoder.feed(ids[i : i + step].tolist())
    yield decoder.finish()


_ENCODERS: dict[int, StreamingEncoder] = {}


def _encoder(definition: str) -> StreamingEncoder:
    """One encoder for each worker process and vocabulary, so its cache outlives a task."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = StreamingEncoder(Merges(definition))
    return _ENCODERS[key]


def _definition(spark: SparkSession, path: str):
    # a vocabulary file has a fixed size, whatever the corpus has
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (array of int): every whole text encoded with the vocabulary at ``path``."""
    definition = _definition(docs.sparkSession, path or vocabulary_path())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        for batch in batches:
            packed = [encoder.encode(t) for t in texts_of(batch.column(1))]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text: every array of ids decoded with the vocabulary at ``path``; null is no ids."""
    definition = _definition(encoded.sparkSession, path or vocabulary_path())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _encoder(definition.value).merges
        for batch in batches:
            packed = [np.array(x or [], dtype="<u4").tobytes() for x in batch.column(1).to_pylist()]
            texts = pa.array(["".join(decode(merges, p)) for p in packed], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return map_arrow(encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")), work, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, from one pass of encoding and decoding; with the ids too if asked for."""
    definition = _definition(docs.sparkSession, path or vocabulary_path())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def one(encoder: StreamingEncoder, text: str) -> tuple[bytes, str, str, int]:
        packed, digest = encoder.encode(text), hashlib.sha256()
        for piece in decode(encoder.merges, packed):
            digest.update(piece.encode())
        return packed if with_ids else b"", hashlib.sha256(packed).hexdigest(), digest.hexdigest(), len(packed) // 4

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                packed, of_ids, of_text, counts = zip(*(one(encoder, t) for t in texts_of(batch.column(1))), strict=True)
                columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over all of ``documents``."""
    return round_trip(read_table(spark, sf_dir, "documents"))
