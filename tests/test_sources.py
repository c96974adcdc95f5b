from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cashtide.sources import charge_feed, run_log, tables

CSV_DDL = "Status string, `Created date (UTC)` timestamp_ntz, Amount double, Description string"


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "charges.csv"
    path.write_text(
        "id,Amount,Status,Created date (UTC),Description,Currency\n"
        "1,10.5,Paid,2021-01-10 09:00:00,Subscription update,aud\n"
        "2,oops,Paid,not a date,\"with, comma\",usd\n"
    )
    return str(path)


def test_csv_is_read_by_column_name(spark, csv_file):
    first, second = tables.read_csv(spark, csv_file, CSV_DDL).orderBy("Description").collect()
    assert first["Created date (UTC)"] == datetime(2021, 1, 10, 9)
    assert (first["Amount"], first["Status"]) == (10.5, "Paid")
    assert second["Amount"] is None and second["Created date (UTC)"] is None
    assert second["Description"] == "with, comma"


def test_missing_columns_are_named(spark, csv_file):
    with pytest.raises(ValueError, match="Nope.*charges.csv"):
        tables.read_csv(spark, csv_file, "Status string, Nope string")


def test_missing_parquet_fails_loudly(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_parquet(spark, str(tmp_path / "absent"), "a int")


def test_optional_table(spark, tmp_path):
    absent = tables.read_optional(spark, str(tmp_path / "absent"), "series string, month date")
    assert absent.columns == ["series", "month"] and absent.isEmpty()
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "there"))
    assert tables.read_optional(spark, str(tmp_path / "there"), "a int").count() == 1


def test_preferred_source_and_provenance(spark, csv_file, tmp_path):
    candidates = [("snapshot", str(tmp_path / "absent.csv")), ("history", csv_file)]
    required = ("Status", "Amount")
    row = tables.read_preferred(spark, candidates, CSV_DDL, required).first()
    assert (row["input_source"], row["input_path"]) == ("history", csv_file)
    row = tables.read_preferred(spark, [("snapshot", csv_file), *candidates], CSV_DDL, required).first()
    assert row["input_source"] == "snapshot"
    with pytest.raises(FileNotFoundError):
        tables.read_preferred(spark, candidates[:1], CSV_DDL, required)


def test_snapshot_columns_to_charges(spark, csv_file):
    frame = charge_feed.charges_from_snapshot(tables.read_csv(spark, csv_file, CSV_DDL))
    assert frame.columns == ["status", "amount", "description", "created"]
    with pytest.raises(ValueError, match="Amount"):
        charge_feed.charges_from_snapshot(frame.withColumnRenamed("status", "Status"))


def test_versions_and_latest(spark, tmp_path):
    root = str(tmp_path / "out")
    assert run_log.latest_version(spark, root, "t") is None
    with pytest.raises(FileNotFoundError):
        run_log.read_latest(spark, root, "t")
    one = spark.createDataFrame([(1,)], "a int")
    run_log.write_versioned(one, root, "t", "20210101T000000Z")
    run_log.write_versioned(one.withColumn("a", F.lit(2)), root, "t", "20210201T000000Z")
    assert run_log.read_latest(spark, root, "t").first()["a"] == 2
    first = spark.read.parquet(f"{root}/t/run_id=20210101T000000Z")
    assert first.first()["a"] == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        run_log.write_versioned(one, root, "t", "20210101T000000Z")


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_formats_round_trip(spark, tmp_path, fmt):
    ddl = "a int, b string, c double"
    frame = spark.createDataFrame([(1, 'x, "y"', 1.5), (2, None, None)], ddl)
    run_log.write_versioned(frame, str(tmp_path), "t", "r1", fmt)
    back = run_log.read_latest(spark, str(tmp_path), "t", fmt, ddl)
    assert sorted(back.collect()) == sorted(frame.collect())


def test_fingerprint_ignores_order_and_sees_content(spark):
    rows = [(i, f"v{i % 7}") for i in range(200)]
    ddl = "a int, b string"
    base = run_log.fingerprint_text(spark.createDataFrame(rows, ddl))
    assert run_log.fingerprint_text(spark.createDataFrame(rows[::-1], ddl).repartition(7)) == base
    changed = [*rows[:-1], (199, "other")]
    assert run_log.fingerprint_text(spark.createDataFrame(changed, ddl)) != base
    assert run_log.fingerprint_text(spark.createDataFrame([*rows, rows[0], rows[0]], ddl)) != base
    assert run_log.fingerprint_text(spark.createDataFrame([], ddl))


def record(spark, run_id, **other):
    facts = dict(
        code_version="c1", pipeline_version="1", input_source="s", input_fingerprint="f1",
        data_through="2021-03-01", rows_in=5, rows_clean=3, months=3,
    )
    return run_log.run_record(spark, run_id=run_id, **{**facts, **other})


def test_run_log_absence_and_corruption_are_kept_apart(spark, tmp_path):
    path = str(tmp_path / "runs")
    root = str(tmp_path)
    assert run_log.last_run(spark, path) is None and run_log.prior_mase(spark, path, root) is None
    evaluated = spark.createDataFrame(
        [("a", "level", 0.5, 2.0, 9.0, True), ("b", "croston", None, 1.0, None, False)],
        "series_id string, model string, mase double, rmse double, winkler80 double, beats_baseline boolean",
    )
    run_log.append_run(record(spark, "r1", evaluated=evaluated, streams=("a", "b")), path)
    later = evaluated.withColumn("mase", F.lit(0.7))
    run_log.append_run(record(spark, "r2", evaluated=later, streams=("a",)), path)
    last = run_log.last_run(spark, path)
    assert last["run_id"] == "r2" and last["model_selections"] == {"a": "level"}
    assert last["metrics"]["a"]["mase"] == 0.7 and last["schema_version"] == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        run_log.prior_mase(spark, path, root)
    run_log.write_versioned(later, root, "evaluation", "r2")
    prior = run_log.prior_mase(spark, path, root)
    assert {r["series_id"]: r["prior_mase"] for r in prior.collect()} == {"a": 0.7, "b": 0.7}
    (tmp_path / "runs" / "broken.json").write_text("{not json")
    with pytest.raises(Exception, match="[Mm]alformed|MALFORMED|FAILED_READ"):
        run_log.last_run(spark, path)


def test_unchanged_needs_same_input_and_code():
    prior = {"input_fingerprint": "f1", "code_version": "c1"}
    assert run_log.unchanged(prior, "f1", "c1")
    assert not run_log.unchanged(prior, "f2", "c1")
    assert not run_log.unchanged(prior, "f1", "c2")
    assert not run_log.unchanged(None, "f1", "c1")


def test_stale_models_are_refused():
    run_log.require_fresh("f1", "f1")
    run_log.require_fresh(None, "f1")
    with pytest.raises(run_log.StaleModelError):
        run_log.require_fresh("f0", "f1")


@pytest.mark.parametrize("wanted, version", [("latest", 3), ("Latest", 3), ("champion", 7), ("9", 9)])
def test_resolve_versions(spark, wanted, version):
    rows = [("m", 1, "v1", None, "r1"), ("m", 3, "v1", None, "r3"), ("m", 7, "v0", "champion", "r7"),
            ("m", 9, None, None, "r9")]
    frame = spark.createDataFrame(
        rows, "model string, version int, contract string, alias string, run_id string"
    )
    row = run_log.resolve_versions(frame, F.lit(wanted), "v1").first()
    assert (row["version"], row["run_id"]) == (version, f"r{version}")


def test_unknown_version_is_an_actionable_error(spark):
    frame = spark.createDataFrame(
        [], "model string, version int, contract string, alias string, run_id string"
    )
    resolved = run_log.resolve_versions(frame, F.lit("champion"), "v1")
    with pytest.raises(LookupError, match="register one first"):
        run_log.require_version(resolved, "champion", "v1")
    with pytest.raises(ValueError, match="positive"):
        run_log.require_version(resolved, "0", "v1")


def test_run_ids_sort_by_time():
    assert run_log.new_run_id(datetime(2026, 7, 16, 10, 15)) == "20260716T101500Z"


def test_fingerprint_tells_where_a_null_is(spark):
    one = spark.createDataFrame([("x", None)], "a string, b string")
    other = spark.createDataFrame([(None, "x")], "a string, b string")
    assert run_log.fingerprint_text(one) != run_log.fingerprint_text(other)


def test_csv_keeps_line_breaks_and_doubled_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"line one\nline two"\n2,"say ""hi"", ok"\n')
    rows = tables.read_csv(spark, str(tmp_path), "k int, v string").orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, "line one\nline two"), (2, 'say "hi", ok')]
