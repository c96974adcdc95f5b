"""Readers for tabular inputs. A schema is always given, so no data is read to guess one."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whichever file system its scheme names."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder this library has written and no longer needs."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def require_columns(df: DataFrame, required: Iterable[str], source: str) -> DataFrame:
    """The same DataFrame, or an error naming every missing column."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing} in {source}")
    return df


def read_parquet(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A Parquet table; a missing path is an error as soon as the plan is built."""
    return spark.read.schema(schema).parquet(path)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    timestamp_columns: Sequence[str] = (),
) -> DataFrame:
    """A CSV table with a header. Columns are matched by header name, so a file may carry more
    columns, in any order, but all files of one table share a header: a file with another one is an
    error. Quoted values may hold line breaks and doubled quotes. ``timestamp_columns`` are parsed
    and become NULL when malformed."""
    wanted = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    # Only the header line is read here, to fail early on a column that is not there.
    header = spark.read.options(header=True, multiLine=True, escape='"', enforceSchema=False).csv(path)
    require_columns(header, wanted.fieldNames(), path)
    # Fields beyond the schema are kept out of the scan by column pruning.
    text = header.select(*[f"`{name}`" for name in wanted.fieldNames()])
    typed = [_typed(field, field.name in timestamp_columns) for field in wanted.fields]
    return text.select(*typed)


def _typed(field: T.StructField, as_time: bool):
    raw = F.col(f"`{field.name}`")
    if as_time or isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return raw.try_cast("timestamp_ntz").alias(field.name)
    if isinstance(field.dataType, T.StringType):
        return raw.alias(field.name)
    return raw.try_cast(field.dataType).alias(field.name)


def read_optional(
    spark: SparkSession, path: str, schema: str | T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """A table that may be absent, or a CSV without even a header; then an empty DataFrame with the same schema.

    Nothing else is forgiven: a table that exists but cannot be read still fails.
    """
    if not path_exists(spark, path) or fmt == "csv" and spark.read.text(path).isEmpty():
        return spark.createDataFrame([], schema)
    if fmt == "csv":
        return read_csv(spark, path, schema)
    return spark.read.schema(schema).format(fmt).load(path)


def read_preferred(
    spark: SparkSession,
    candidates: Sequence[tuple[str, str]],
    schema: str | T.StructType,
    required: Iterable[str],
    fmt: str = "csv",
) -> DataFrame:
    """The first existing of ``(label, path)`` candidates, with its provenance in two columns."""
    for label, path in candidates:
        if not path_exists(spark, path):
            continue
        if fmt == "csv":
            frame = read_csv(spark, path, schema)
        else:
            frame = spark.read.schema(schema).format(fmt).load(path)
        require_columns(frame, required, path)
        return frame.withColumn("input_source", F.lit(label)).withColumn("input_path", F.lit(path))
    raise FileNotFoundError(f"no input found among {[path for _, path in candidates]}")
