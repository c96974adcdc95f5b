"""The input fingerprint of a partitioned table, kept up to date: only partitions whose files changed are read again.

Fingerprints are sums, so those of partitions add up to that of the table. A digest per partition is stored with a stamp
of its files (names, sizes, times), which a listing gives without reading them. A partition with another stamp,
or without a digest, is read; digests of partitions that are gone go too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cashtide.sources import run_log

#: The stored table of digests, below the folder that is named for it.
TABLE = "digests"
DIGESTS = "folder string, stamp string, rows bigint, hash_sum decimal(38,0), hash_xor bigint, schema_hash bigint"


def _folder(path: Column, by: str) -> Column:
    """``<by>=<value>`` of a file's path."""
    return F.regexp_extract(path, f"/({by}=[^/]*)/", 1)


def _decoded(path: Column) -> Column:
    """The path of a row's file as a listing shows it: there it is no URI."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def stamps(spark: SparkSession, path: str, by: str) -> DataFrame:
    """(folder, stamp) of every partition, from the listing of its files alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    listed = F.xxhash64(F.regexp_extract("path", "([^/]*)$", 1), "modificationTime", "length")
    return files.groupBy(_folder(F.col("path"), by).alias("folder")).agg(
        F.concat_ws("-", F.count("*"), F.sum("length"), F.bit_xor(listed)).alias("stamp")
    )


def refresh(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    by: str,
    store: str,
    run_id: str,
    columns: Sequence[Column] = (),
) -> str:
    """The fingerprint of the Parquet table at ``path``, partitioned by ``by``, or of some ``columns`` of it.

    Equal to ``run_log.fingerprint_text(table.select(*columns))``. Use another ``store`` for other columns or another
    ``schema``, which includes the partition column. New digests are published as version ``run_id`` below
    ``store``; without any change nothing is written and no row is read.
    """
    now = stamps(spark, path, by)
    found = run_log.latest_version(spark, store, TABLE)
    old = spark.read.schema(DIGESTS).parquet(found[1]) if found else spark.createDataFrame([], DIGESTS)
    kept = old.join(now, ["folder", "stamp"], "left_semi")
    # A row per partition that changed: as many folders as are then read.
    changed = [row.folder for row in now.join(old, ["folder", "stamp"], "left_anti").select("folder").collect()]
    if changed or found is None or kept.count() < old.count():
        digests = kept
        if changed:
            raw = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{folder}" for folder in changed])
            wanted = list(columns) or [F.col(f"`{c}`") for c in raw.columns]
            rows = raw.select(*wanted, _folder(_decoded(F.col("_metadata.file_path")), by).alias("_folder"))
            counted = rows.groupBy(F.col("_folder").alias("folder")).agg(*run_log.fingerprint_aggregates(raw.select(*wanted)))
            digests = kept.unionByName(counted.join(now, "folder").select(*kept.columns))
        # Written anew as a whole: a row per partition.
        run_log.write_versioned(digests.coalesce(1), store, TABLE, run_id)
        old = spark.read.schema(DIGESTS).parquet(run_log.latest_version(spark, store, TABLE)[1])
    total = old.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.sum("hash_sum").alias("hash_sum"),
        F.bit_xor("hash_xor").alias("hash_xor"),
        F.max("schema_hash").alias("schema_hash"),
    )
    return run_log.as_text(total.first().asDict())
