"""The registered queries over whole tables: columns of the contracts, one row per document where they say so, SQL where there is one."""

import re
import sys
import zlib
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_pii import brute as pii_brute  # noqa: E402
from test_simhash import brute_components, slow_fingerprint  # noqa: E402

import __spark_entry__  # noqa: E402
from tessera.llm import registry  # noqa: E402

DIRECTORY = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIRECTORY).exists(), reason="the test tables are not here")

COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id",
    "op2_decontaminate": "doc_id item_id n_windows n_found similarity n_changed",
    "op3_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans n_added",
    "op4_toxicity": "doc_id held_out score predicted",
    "op5_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op9_quality": "doc_id held_out score predicted",
    "op10_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIRECTORY}/documents.parquet").collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, documents, name):
    frame = __spark_entry__.queries()[name](spark, DIRECTORY)
    assert frame.columns == COLUMNS[name].split()
    rows = frame.collect()
    ids = [r.doc_id for r in rows]
    if name == "op2_decontaminate":
        assert set(ids) < set(documents)
    else:
        assert sorted(ids) == sorted(documents)
    if name in registry.ORACLE_SQL:
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{DIRECTORY}/documents.parquet'")
        found = con.execute(registry.ORACLE_SQL[name])
        order = [[c[0] for c in found.description].index(c) for c in frame.columns]
        assert sorted(map(tuple, rows)) == sorted(tuple(r[i] for i in order) for r in found.fetchall())
    if name == "op1_simhash":
        prints = {i: slow_fingerprint(t) for i, t in documents.items()}
        root, least = brute_components(set(prints.values())), {}
        for i, f in prints.items():
            least[root[f]] = min(i, least.get(root[f], i))
        assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{f:016x}", least[root[f]]) for i, f in prints.items()}
    if name == "op3_pii":
        for r in rows:
            base = pii_brute(documents[r.doc_id])
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for *_, k in base) for kind in ("email", "ip", "card", "phone"))
            assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(r.spans.split(","))
            assert re.fullmatch("[0-9a-f]{64}", r.base_sha256)
    if "held_out" in frame.columns:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)


def test_labels_of_the_held_out_fold_do_not_matter(spark, tmp_path):
    """Scores are the same when labels of fold 0 are turned round."""
    from pyspark.sql import functions as F

    from tessera.llm.common import fold_of

    docs, labels = (spark.read.parquet(f"{DIRECTORY}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumns({c: F.when(fold_of(F.col("doc_id")) == 0, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    turned.write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op4_toxicity", "op9_quality"):
        one, two = ({r.doc_id: r.score for r in registry.QUERIES[name](spark, d).collect()} for d in (DIRECTORY, str(tmp_path)))
        assert one.keys() == two.keys() and all(abs(one[i] - two[i]) < 1e-9 for i in one)
