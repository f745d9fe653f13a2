"""The pipeline against the same decisions by plain code, stage by stage."""

import hashlib
import random
import sys
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_quality_rules import brute as rules  # noqa: E402
from test_simhash import brute_components, slow_fingerprint  # noqa: E402

import corpus_pipeline  # noqa: E402
from tessera.llm import bpe, pii  # noqa: E402

DIRECTORY = "/root/testdata/sf0.001"


def expected(rows, items):
    kept = [r for r, k in zip(sorted(rows, key=str), rules([(r[0], r[1], r[3]) for r in rows]), strict=True) if k[-1]]
    prints = [slow_fingerprint(r[1] or "") for r in kept]
    root = brute_components(set(prints))
    least = {}
    for r, f in zip(kept, prints, strict=True):
        least[root[f]] = min(least.get(root[f], r[0]), r[0])
    kept = [r for r, f in zip(kept, prints, strict=True) if least[root[f]] == r[0]]
    kept = {r[0]: r for r in kept}.values()
    kept = [r for r in kept if not any(t in r[1] for _, t in items)]
    return [(r[0], pii.redact_text(r[1], pii.find_all(r[1])[1])) for r in kept]


@pytest.mark.skipif(not Path(DIRECTORY).exists(), reason="the test tables are not here")
def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    items = spark.read.parquet(f"{DIRECTORY}/benchmark.parquet").collect()
    library = Tokenizer.from_file(bpe.vocabulary_path())
    truth = {}
    for i, text in expected(list(map(tuple, docs)), items):
        ids = library.encode(text, add_special_tokens=False).ids
        truth[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in corpus_pipeline.run(spark, DIRECTORY).collect()}
    assert got == truth and 50 < len(got) < len(docs)


def test_stages_keep_columns_and_bear_odd_rows(spark):
    r = random.Random(1)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b = text(), text()
    rows = [(1, a, "en", "s", 3), (1, a, "en", "s", 3), (2, a, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, b, "en", "s", 1), (5, "mail a@b.co " + text(), "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'r' as row", "1L as text_key", "2 as component_id")
    frame, names = docs, docs.columns
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, DIRECTORY)
        assert frame.columns == names and frame.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        seen.append(sorted((x.doc_id for x in frame.collect()), key=str))
    assert seen == [[1, 1, 2, 5, None], [1, 5, None], [1, 5, None], [1, 5, None]]
    redacted = next(x for x in frame.collect() if x.doc_id == 5)
    assert redacted.text.startswith("mail <EMAIL> ") and redacted.n_chars == len(redacted.text)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIRECTORY).count() == 0
