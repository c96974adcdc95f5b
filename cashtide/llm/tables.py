"""Reading the corpus tables, and written tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.session import scratch_dir


def corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The same rows, stored once in the shared folder: what follows survives a lost executor."""
    path = scratch_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


#: Residues of ids that are broadcast at most, whatever the number of ids.
RESIDUES = 1 << 20


def _residue(column: Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(RESIDUES)).cast("int")


def split_by_ids(rows: DataFrame, column: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` that may have one of the ``ids`` (one column), and those that surely have none.

    Only residues of the ids are sent to the tasks, ``RESIDUES`` numbers at most, so long rows are told apart
    without being moved. With many more ids than residues most rows are in the first part; nothing gets wrong.
    """
    known = F.broadcast(ids.select(_residue(ids[ids.columns[0]]).alias("_residue")).distinct())
    named = rows.withColumn("_residue", _residue(F.col(column)))
    return named.join(known, "_residue", "left_semi").drop("_residue"), named.join(known, "_residue", "left_anti").drop("_residue")
