"""op8: token ids of every document. Checked against the tokenizers library, not by SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cashtide.llm import bpe
from cashtide.llm.tables import corpus


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.digests(corpus(spark, sf_dir, "documents"), vocabulary)


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict[str, str] = {}
