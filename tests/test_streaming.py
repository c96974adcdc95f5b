from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cashtide.operators.contracts import Rule
from cashtide.session import scratch_dir
from cashtide.streaming import revenue

DDL = "event_id long, ts timestamp, event_type string, value double"
START = datetime(2024, 1, 1, 12)


def add_file(spark, path, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(path)


def test_redelivery_in_a_later_run_is_dropped(spark, tmp_path):
    feed, root = str(tmp_path / "feed"), str(tmp_path / "out")
    rows = [(i, START + timedelta(hours=i), "click", 1.0) for i in range(5)]

    def ingest():
        stream = revenue.file_stream(spark, feed, DDL)
        revenue.ingest_to(stream, "event_id", "ts", f"{root}/table", f"{root}/checkpoint").awaitTermination()
        return sorted((r["event_id"] is None, r["event_id"]) for r in spark.read.parquet(f"{root}/table").collect())

    add_file(spark, feed, [*rows, (None, START, "click", 1.0), (7, None, "click", 1.0)])
    ingest()
    add_file(spark, feed, [*rows[3:], (9, START + timedelta(hours=9), "click", 1.0), (7, None, "click", 1.0)])
    assert ingest() == [*((False, i) for i in (0, 1, 2, 3, 4, 7, 9)), (True, None)]


@pytest.mark.parametrize("files", [1, 1000])
def test_a_replay_with_the_newest_file_first_loses_nothing(spark, tmp_path, files):
    feed = str(tmp_path / "feed")
    for day in (20, 11, 6, 1):
        add_file(spark, feed, [(10 * day + i, datetime(2024, 1, day + i, 12), "click", 1.25) for i in range(3)])
    stream = lambda: revenue.file_stream(spark, feed, DDL, files_per_trigger=files)
    assert revenue.ingested(stream(), "event_id", "ts").count() == 12
    windows = revenue.windows_of(revenue.windowed_revenue(stream(), "event_type", "value", "ts")).collect()
    assert sorted(w["window_start"].day for w in windows) == [1, 2, 3, 6, 7, 8, 11, 12, 13, 20, 21, 22]
    assert all((w["n"], float(w["revenue"])) == (1, 1.25) for w in windows)


def test_stream_quarantine_loses_nothing(spark, tmp_path):
    feed, root = str(tmp_path / "feed"), str(tmp_path / "out")
    rules = [Rule("value_positive", "value", F.col("value") > 0)]
    for batch in range(2):
        rows = [(10 * batch + i, START, "click", float(i - 1)) for i in range(4)]
        add_file(spark, feed, rows)
        revenue.quarantine_to(
            revenue.file_stream(spark, feed, DDL), rules, f"{root}/good", f"{root}/bad", f"{root}/cp"
        ).awaitTermination()
    good, bad = spark.read.parquet(f"{root}/good"), spark.read.parquet(f"{root}/bad")
    assert (good.count(), bad.count()) == (4, 4)
    assert {tuple(r["reasons"]) for r in bad.collect()} == {("value_positive",)}
    assert {r["batch_id"] for r in good.select("batch_id").distinct().collect()} == {0, 1}


def test_scratch_lies_below_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark, "x").startswith(f"{shared}/x-")


def test_cluster_without_shared_folder_is_refused():
    class Conf:
        def get(self, key, default):
            return default

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(Cluster(), "x")
