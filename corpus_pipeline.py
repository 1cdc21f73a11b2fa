"""Corpus pipeline: quality rules, exact and near deduplication, repeated passages, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's documents.  All but the last keep the columns of
``documents``.  A stage deletes the intermediates of the stage before it, whose
result has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlattice.llm import exact_dedup, packing, quality_rules, simhash_trie, storage, substring_dedup

#: Intermediates of the stage that this thread ran last.
_spent: ContextVar[tuple[str, ...]] = ContextVar("intermediates of the stage before", default=())


def _staged(spark: SparkSession, work: Callable[[], DataFrame], first: bool = False) -> DataFrame:
    """Run a stage's work; what the stage before it left goes, as its result has been written and read again."""
    if not first:
        for path in _spent.get():
            storage.delete(spark, path)
    with storage.collecting() as made:
        result = work()
    _spent.set(tuple(made))
    return result


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return _staged(spark, lambda: quality_rules.filter_documents(docs), first=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space, the one with the smallest id."""
    return _staged(spark, lambda: exact_dedup.deduplicate(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest id."""
    return _staged(spark, lambda: simhash_trie.deduplicate(docs))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that a document with a smaller id has."""
    return _staged(spark, lambda: substring_dedup.clean_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, placed in sequences."""
    pieces = _staged(spark, lambda: packing.pack(docs))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids")


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("substring_dedup", passages), ("packing", pack)]

#: Fingerprints, tokens and packing have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``, each written and read again.

    A stage's input goes when its result has been written, the last result when the
    application ends.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = storage.new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            storage.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
