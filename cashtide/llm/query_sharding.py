"""op9: documents in eight shards of nearly equal bytes. Checked by its laws, not by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cashtide.llm import sharding
from cashtide.llm.tables import corpus


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(corpus(spark, sf_dir, "documents"))


QUERIES = {"op9_sharding": op9_sharding}
ORACLES: dict[str, str] = {}
