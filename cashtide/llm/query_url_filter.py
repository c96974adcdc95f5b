"""op1: a verdict for every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cashtide.llm import url_filter
from cashtide.llm.tables import corpus
from cashtide.llm.url_filter import Rule

#: Fixed values of the contract.
RULES = [
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(corpus(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLES: dict[str, str] = {}
