"""op4: the language of every document, learned from three quarters of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.llm import language
from cashtide.llm.tables import corpus


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def model(docs: DataFrame) -> language.Model:
    return language.fit(docs.where(~held_out()))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    named = language.identify(docs.select("doc_id", "text"), model(docs))
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op4_language": op4_language}
ORACLES: dict[str, str] = {}
