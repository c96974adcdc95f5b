"""Structured Streaming: deduplicated ingest, windowed revenue, and the quality gate.

No result depends on the order in which files arrive or on how many a trigger takes: nothing is dropped
for being late. :func:`ingested` and :func:`windows_of` run a stream to the end of what is available and
return the written table.

Every sink follows a ledger (:mod:`cashtide.sources.ledger`): a batch writes into a folder of its own attempt and
then appends one commit under the id of its stream, which is that of the checkpoint. A batch that is repeated
finds its commit and does nothing, one that died leaves a folder nobody reads, and several streams, or a stream begun anew
with another checkpoint, may share a table: none touches what another has written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cashtide.operators.contracts import Rule, with_reasons
from cashtide.session import scratch_dir
from cashtide.sources.ledger import FOLDER, Commit, Ledger, Part, parts_of, read_parts
from cashtide.sources.tables import remove_folder

#: Files a batch may write for a day, so that a day with most of the rows is spread over tasks.
FILES_A_DAY = 16

#: The day of rows without an event time.
NO_DAY = "0001-01-01"

#: Names of the tables in the ledgers here.
ROWS, WINDOWS, GOOD, BAD = "rows", "windows", "good", "bad"


def file_stream(
    spark: SparkSession,
    directory: str,
    schema: str | T.StructType,
    name_filter: str = "*.parquet",
    files_per_trigger: int = 1000,
) -> DataFrame:
    """A stream of the Parquet files that arrive in a directory."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name_filter)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(directory)
    )


def _ledger(spark: SparkSession, table: str) -> Ledger:
    return Ledger(spark, f"{table}/{FOLDER}")


def _stream_id(spark: SparkSession) -> str:
    """The id of the stream whose batch is being written; it is kept in the checkpoint."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId")


def _attempt(table: str, stream: str, batch_id: int) -> str:
    """A folder that no other attempt, batch or stream writes to."""
    return f"{table}/stream_id={stream}/batch_id={batch_id}/attempt={uuid.uuid4().hex}"


def first_deliveries(rows: DataFrame, key: str, event_time: str) -> DataFrame:
    """One row per key: the earliest by event time, a missing time last; among equal times one by content."""
    plain = not any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in rows.schema)
    content = F.xxhash64(*[f"`{c}`" for c in rows.columns]) if plain else F.to_json(F.struct("*"))
    order = F.struct(F.col(event_time).isNull(), F.col(event_time), content)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*[f"`{c}`" for c in rows.columns]), order).alias("_row")).select("_row.*")


def ingest_to(stream: DataFrame, key: str, event_time: str, table: str, checkpoint: str) -> StreamingQuery:
    """Each key once, in a Parquet table partitioned by batch and day of the event; rows without a key all stay.

    A batch is held against the days it has in what was committed before, by this stream or another, so history
    may come in any order and no state is kept. Streams that run at the same time do not write a key twice: of two
    batches that started from the same commits the later one looks again. A redelivery must carry the event time of the
    first delivery; of differing rows of one key in a batch :func:`first_deliveries` stays.
    """
    kept = _ingest_schema(stream.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream_id = _stream_id(spark)
        rows = batch.withColumn("event_day", F.coalesce(F.to_date(event_time), F.lit(NO_DAY).cast("date")))

        def store(commits: list[Commit]) -> list[Part]:
            fresh = first_deliveries(rows.where(F.col(key).isNotNull()), key, event_time)
            if earlier := parts_of(commits, ROWS):
                days = fresh.select("event_day").distinct()
                known = read_parts(spark, table, earlier, kept).join(days, "event_day", "left_semi").select(key)
                fresh = fresh.join(known, key, "left_anti").select(*rows.columns)
            path = _attempt(table, stream_id, batch_id)
            (
                fresh.unionByName(rows.where(F.col(key).isNull()))
                .repartition("event_day", F.pmod(F.xxhash64(key), F.lit(FILES_A_DAY)))
                .write.partitionBy("event_day")
                .parquet(path)
            )
            return [Part(ROWS, path)]

        _ledger(spark, table).once(stream_id, batch_id, store)

    return _available(stream.writeStream.foreachBatch(write), checkpoint)


def _ingest_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("event_day", T.DateType()), T.StructField("batch_id", T.LongType())])


def read_ingested(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """What has been committed to an ingest table: the columns of the stream with ``schema``, day and batch."""
    return read_parts(spark, table, parts_of(_ledger(spark, table).commits(), ROWS), _ingest_schema(schema))


def windowed_revenue(
    stream: DataFrame, category: str, amount: str, event_time: str, width: str = "1 day"
) -> DataFrame:
    """Count and revenue per tumbling window and category, for all rows however late.

    The state is one row per window and category: it grows with the calendar, not with the rows. Map-side
    partial aggregation keeps a hot category from skewing the state shuffle.
    """
    return (
        stream.groupBy(F.window(event_time, width).alias("w"), F.col(category).alias("category"))
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col(amount).cast("decimal(18,2)")).alias("revenue"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "category",
            "n",
            "revenue",
        )
    )


def windows_to(windows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Publish the windows that a batch has changed, by rewriting the days they begin on and no others.

    A batch brings its changed windows with their whole counts; they replace their like in the days of this stream,
    and the commit names the new folder of each day. A late row changes an old day like any other.
    """
    stored = _window_schema(windows.schema)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream_id = _stream_id(spark)
        # Taken from the state store once, and whole: also a repeated batch must, or its state would not be kept.
        draft = f"{table}/_changes/{uuid.uuid4().hex}"
        batch.withColumn("day", F.to_date("window_start")).write.parquet(draft)
        changed = spark.read.schema(stored).parquet(draft)

        def store(commits: list[Commit]) -> list[Part]:
            path = _attempt(table, stream_id, batch_id)
            # As many rows as the batch has days.
            days = sorted(str(row.day) for row in changed.select("day").distinct().collect())
            own = parts_of((c for c in commits if c.writer == stream_id), WINDOWS)
            before = read_parts(spark, table, [p for p in own if p.key in days], stored)
            same = [before[c].eqNullSafe(changed[c]) for c in ("window_start", "window_end", "category")]
            whole = before.join(changed, same, "left_anti").unionByName(changed)
            whole.repartition("day").write.partitionBy("day").parquet(path)
            return [Part(WINDOWS, f"{path}/day={day}", day) for day in days]

        _ledger(spark, table).once(stream_id, batch_id, store)
        remove_folder(spark, draft)

    return _available(windows.writeStream.outputMode("update").foreachBatch(write), checkpoint)


def _window_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("day", T.DateType())])


def newest_windows(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The windows as of the last commit; an empty table before the first. Streams that share the table are added up."""
    stored = read_parts(spark, table, parts_of(_ledger(spark, table).commits(), WINDOWS), _window_schema(schema))
    added = [F.sum(c).cast(schema[c].dataType).alias(c) for c in ("n", "revenue")]
    return stored.groupBy("window_start", "window_end", "category").agg(*added).select(*schema.names)


def _available(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quarantine_to(
    stream: DataFrame, rules: Sequence[Rule], good: str, bad: str, checkpoint: str
) -> StreamingQuery:
    """Valid rows to one table, the others with their reasons to a second one; a batch is judged once.

    Both parts of a batch are in one commit, in the ledger of ``good``: readers see both or neither.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream_id = _stream_id(spark)
        written: list[Part] = []

        def store(commits: list[Commit]) -> list[Part]:
            if not written:  # what other streams commit does not change these rows
                judged = with_reasons(batch, rules).persist()
                valid = F.size("reasons") == 0
                sinks = (GOOD, good, judged.where(valid).drop("reasons")), (BAD, bad, judged.where(~valid))
                try:
                    parts = [Part(name, _attempt(table, stream_id, batch_id)) for name, table, _ in sinks]
                    for part, (_, _, rows) in zip(parts, sinks, strict=True):
                        rows.write.parquet(part.path)
                finally:
                    judged.unpersist()
                written.extend(parts)
            return written

        _ledger(spark, good).once(stream_id, batch_id, store)

    return _available(stream.writeStream.foreachBatch(write), checkpoint)


def read_judged(spark: SparkSession, good: str, bad: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, the others) of the last commit. ``schema`` may name ``batch_id``, ``stream_id`` and, for the
    others, ``reasons``."""
    commits = _ledger(spark, good).commits()
    return read_parts(spark, good, parts_of(commits, GOOD), schema), read_parts(spark, bad, parts_of(commits, BAD), schema)


def ingested(stream: DataFrame, key: str, event_time: str) -> DataFrame:
    """Ingest everything available into a scratch table and read that table."""
    root = scratch_dir(stream.sparkSession, "ingest")
    ingest_to(stream, key, event_time, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return read_ingested(stream.sparkSession, f"{root}/table", stream.schema).select(*stream.columns)


def windows_of(windows: DataFrame) -> DataFrame:
    """Bring the windows up to everything available and read them."""
    spark, root = windows.sparkSession, scratch_dir(windows.sparkSession, "windows")
    windows_to(windows, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return newest_windows(spark, f"{root}/table", windows.schema)
