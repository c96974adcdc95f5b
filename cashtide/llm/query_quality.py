"""op10: the quality of every document, learned from two thirds of the labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.llm import quality
from cashtide.llm.tables import corpus


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir, "documents").select("doc_id", "text")
    labels = corpus(spark, sf_dir, "labels").where(~held_out())
    scored = quality.rate(docs, quality.fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality": op10_quality}
ORACLES: dict[str, str] = {}
