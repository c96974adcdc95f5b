"""Fingerprints of partitioned tables: equal to the whole one, and kept without reading what has not changed."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cashtide.sources import partition_digests, run_log

DDL = "id long, amount double, note string, month string"


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "charges")
    add(spark, path, "2024-01", 50)
    add(spark, path, "2024-02", 30)
    return path


def add(spark, path, month, n, start=0):
    rows = [(start + i, i / 4, None if i % 7 == 0 else f"n{i}", month) for i in range(n)]
    spark.createDataFrame(rows, DDL).repartition(2).write.mode("append").partitionBy("month").parquet(path)


def whole(spark, path, *columns):
    frame = spark.read.schema(DDL).parquet(path)
    return run_log.fingerprint_text(frame.select(*columns) if columns else frame)


def spoil(path, month):
    """Make the files of a month unreadable without a trace in a listing."""
    for file in Path(path).glob(f"month={month}/*.parquet"):
        before = file.stat()
        file.write_bytes(b"x" * before.st_size)
        os.utime(file, ns=(before.st_atime_ns, before.st_mtime_ns))


def test_adding_a_month_reads_that_month_only(spark, table, tmp_path):
    store = str(tmp_path / "store")
    refresh = lambda run_id: partition_digests.refresh(spark, table, DDL, "month", store, run_id)
    assert refresh("a") == whole(spark, table)
    add(spark, table, "2024-03", 20)
    expected = whole(spark, table)
    spoil(table, "2024-01")
    spoil(table, "2024-02")
    assert refresh("b") == expected
    spoil(table, "2024-03")
    assert refresh("c") == expected  # nothing changed: nothing is read, nothing is written
    assert run_log.latest_version(spark, store, partition_digests.TABLE)[0] == "b"


def test_changed_and_removed_months_are_seen(spark, table, tmp_path):
    store = str(tmp_path / "store")
    refresh = lambda run_id: partition_digests.refresh(spark, table, DDL, "month", store, run_id)
    first = refresh("a")
    add(spark, table, "2024-02", 1, start=900)
    second = refresh("b")
    assert second == whole(spark, table) != first
    shutil.rmtree(f"{table}/month=2024-01")
    assert refresh("c") == whole(spark, table) not in (first, second)
    shutil.rmtree(f"{table}/month=2024-02")
    assert refresh("d") == run_log.fingerprint_text(spark.createDataFrame([], DDL))


def test_order_and_missing_values(spark, tmp_path):
    paths = [str(tmp_path / name) for name in ("one", "two", "three")]
    rows = [(1, None, "x", "m"), (2, 1.0, None, "m"), (3, 2.0, "z", None), (4, 2.0, "z", "a b/c")]
    for path, given in zip(paths, (rows, rows[::-1], [(1, None, None, "m"), (2, 1.0, "x", "m"), *rows[2:]])):
        spark.createDataFrame(given, DDL).coalesce(1).write.partitionBy("month").parquet(path)
    found = [partition_digests.refresh(spark, p, DDL, "month", f"{p}-store", "a") for p in paths]
    assert found[0] == found[1] == whole(spark, paths[0]) and found[2] != found[0]


def test_some_columns_under_other_names(spark, table, tmp_path):
    columns = [F.col("amount"), F.col("note").alias("description")]
    found = partition_digests.refresh(spark, table, DDL, "month", str(tmp_path / "store"), "a", columns)
    assert found == whole(spark, table, *columns)
