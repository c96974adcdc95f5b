"""The corpus pipeline: raw documents to token ids, five stages, each stored before the next reads it.

Every stage takes ``(spark, docs, sf_dir)``, works on all documents its predecessor kept, and returns the
columns of documents; the last one returns what it made of each document's tokens. Null, empty and very
long texts, repeated rows, empty tables and further columns are handled as the operators say. What can
go wrong in one stage is retried from the stored rows of the one before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cashtide.llm import bpe, decontaminate, exact_dedup, language, parity_join
from cashtide.llm.tables import corpus, written


#: Rows of documents that pass to Python at a time. Texts are some kilobytes each and may be much longer, so Spark's
#: ten thousand rows are tens of megabytes, held by the executor and by the worker, twice where rows also return.
BATCH_ROWS = 1000


def _bounded(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification, learned from the documents' own labels: documents it rejects go."""
    _bounded(spark)
    return language.accepted(docs, language.fit(docs))


def drop_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup through the extendible-hash index: of equal texts the row with the largest doc_id stays."""
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8: of each class the smallest doc_id stays."""
    _bounded(spark)
    return parity_join.one_of_each(docs, k=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    _bounded(spark)
    return decontaminate.clean(docs, corpus(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the number of token ids of each document, and digests of them and of their text."""
    _bounded(spark)
    return bpe.digests(docs, bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("language ID", keep_known_languages),
    ("exact dedup", drop_equal_texts),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("BPE encoding and decoding", encode_texts),
]

#: SQL cannot express a learned classifier or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and reread."""
    docs = corpus(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
