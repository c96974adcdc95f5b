"""op2: classes of documents whose three-word shingles are alike. Checked by brute force, not by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cashtide.llm import parity_join
from cashtide.llm.tables import corpus


def op2_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_classes(corpus(spark, sf_dir, "documents"), k=3, percent=90)


QUERIES = {"op2_parity_join": op2_parity_join}
ORACLES: dict[str, str] = {}
