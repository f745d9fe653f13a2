import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def encoder():
    with open(PATH) as f:
        return bpe.StreamingEncoder(bpe.Merges(f.read()))


def texts():
    r = random.Random(5)
    yield from ["", " ", "  \n\t x  y \r\n", "it's we'll 'S don't", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|", "naïve Ünïcode ß 中文字 🙂👩‍👩‍👧 é", "x" * 30_000, "ab" * 9000, "1" * 5000, "=" * 4000 + "-" * 3000, "   a\u0085b", "\0\x01 nul"]
    for n in (5, 40, 300, 5000):
        for letters in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "the ing and ", "0123456789. ", "äöüß éèçñ", "ab\n\t  '.,;"):
            yield "".join(r.choice(letters) for _ in range(n))
    for _ in range(60):
        yield "".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 0x2000), r.randrange(0x1F300, 0x1F700)])) for _ in range(r.randrange(60)))


def test_same_ids_as_the_library(library, encoder):
    for text in texts():
        expected = library.encode(text, add_special_tokens=False).ids
        packed = encoder.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == expected, text[:80]
        assert "".join(bpe.decode(encoder.merges, packed, 7)) == library.decode(expected, skip_special_tokens=False)


def test_window_is_bounded_and_chunks_do_not_matter(library, encoder):
    r = random.Random(9)
    assert 0 < encoder.ahead < 4096
    data = "".join(r.choice(["th", "ing", "e", "r", "tion", "un", "q", "s"]) for _ in range(8000))
    expected = library.encode(data, add_special_tokens=False).ids
    for step in (1, 97, 5000):
        chunks = (data.encode()[i : i + step] for i in range(0, len(data), step))
        assert list(encoder.transduce(chunks)) == expected


def test_decoding_broken_bytes(library, encoder):
    r = random.Random(3)
    for _ in range(200):
        ids = [r.choice(encoder.merges.byte_ids) for _ in range(r.randrange(1, 30))]
        packed = np.array(ids, "<u4").tobytes()
        assert "".join(bpe.decode(encoder.merges, packed, 3)) == library.decode(ids, skip_special_tokens=False)


def test_documents(spark, library):
    rows = [(1, "Hello  world", "x"), (2, None, "y"), (2, None, "y"), (None, "", "z"), (3, "word " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip(docs, PATH).collect()
    assert len(got) == 5
    for row in got:
        text = {1: "Hello  world", 3: "word " * 50_000}.get(row.doc_id, "")
        ids = library.encode(text, add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH)
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _ in rows)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
