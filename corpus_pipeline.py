"""A training-corpus pipeline: quality rules, near-duplicate removal, decontamination, redaction and tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in the shared checkpoint folder and reads it
again as the next one's documents, so a lost executor costs tasks of one stage only. What a stage has read goes once the next is written;
the last one's rows stay for the caller.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import round_trip
from tessera.llm.common import ensure_checkpoint_dir, read_table
from tessera.llm.decontaminate import without_leaks
from tessera.llm.pii import redact
from tessera.llm.quality_rules import kept_documents
from tessera.llm.simhash import keep_one_of_each


def _counted_again(docs: DataFrame, clean: DataFrame) -> DataFrame:
    """``clean`` with ``docs``' columns, ``n_chars`` (if there) counted again."""
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines that are frequent in their source, ``n_chars`` counted again."""
    return _counted_again(docs, kept_documents(docs))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each component of near duplicates."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the names of their kinds, ``n_chars`` counted again."""
    return _counted_again(docs, redact(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of ids and decoded text of each document."""
    return round_trip(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", dedup),
    ("decontaminate", decontaminate),
    ("redact_pii", redact_pii),
    ("tokenize", tokenize),
]

#: SQL can express neither fingerprints nor byte-pair encoding.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of whatever store it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; the last stage's rows."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4()}"
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs
