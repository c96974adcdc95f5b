"""Whole runs over a small made-up history."""

from __future__ import annotations

from datetime import date, datetime

import numpy as np
import pytest
from conftest import CHARGE_DDL
from pyspark.sql import functions as F

from cashtide import Settings
from cashtide.operators import backtest, contracts, forecasters, monthly
from cashtide.operators.contracts import ContractError
from cashtide.operators.selection import RegressionError
from cashtide.plans import revenue_run
from cashtide.sources import run_log

SETTINGS = Settings(
    as_of=date(2023, 1, 15), series_start=date(2017, 1, 1), disruption_end=date(2017, 4, 1), cv_windows=2
)


def history(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(72):
        when = datetime(2017 + i // 12, i % 12 + 1, 10)
        season = 1 + 0.3 * np.sin(i / 12 * 2 * np.pi)
        rows.append(("Paid", when, round(float(1000 * season + rng.normal(0, 20)), 2), "aud", "Subscription update"))
        rows.append(("Paid", when, round(float(rng.uniform(100, 900)), 2), None, "Package initiation"))
        if i % 2:
            rows.append(("Paid", when, round(float(rng.uniform(50, 99)), 2), "AUD", "IV League - Booking"))
        rows.append(("Failed", when, 5.0, "aud", "x"))
        rows.append(("Paid", when, 5.0, "usd", "x"))
    return spark.createDataFrame(rows, CHARGE_DDL)


def executed_plans(spark, since):
    """Texts of the physical plans of all queries after the first ``since``, and their number."""
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(i).physicalPlanDescription() for i in range(since, found.size())], found.size()


@pytest.fixture(scope="module")
def first_run(spark, tmp_path_factory):
    root, path = (str(tmp_path_factory.mktemp(name)) for name in ("published", "charges"))
    history(spark).write.mode("overwrite").parquet(path)
    charges = spark.read.schema(CHARGE_DDL).parquet(path)
    _, before = executed_plans(spark, 0)
    outcome = revenue_run.run(charges, SETTINGS, root, code_version="c1", run_id="r1")
    return root, charges, outcome, path, executed_plans(spark, before)[0]


@pytest.fixture(scope="module")
def published(first_run):
    return first_run[:3]


def test_run_counts(published):
    _, _, outcome = published
    assert (outcome.skipped, outcome.rows_in, outcome.rows_clean, outcome.months) == (False, 324, 180, 72)


def test_published_tables(spark, published):
    root, _, _ = published
    table = {r["series_id"]: r for r in run_log.read_latest(spark, root, "evaluation").collect()}
    assert set(table) == set(SETTINGS.streams)
    assert table["recurring"]["mase"] < 1.0
    for months in (12, 24):
        wide = run_log.read_latest(spark, root, f"forecast_{months}m").orderBy("month").collect()
        assert len(wide) == months and wide[0]["month"] == date(2023, 1, 1)
        for r in wide:
            assert 0 <= r["bear"] <= r["base"] <= r["bull"]
            parts = sum(r[s] for s in SETTINGS.streams)
            assert r["total_base"] == pytest.approx(parts, abs=0.05)
    summary = {r["category"]: r["transactions"] for r in run_log.read_latest(spark, root, "category_summary").collect()}
    assert summary == {"recurring": 72, "one_time": 72, "league": 36}


def test_thirty_months_are_forecast_without_a_backtest(spark, tmp_path):
    short = Settings(as_of=date(2019, 7, 15), series_start=date(2017, 1, 1), disruption_end=date(2017, 4, 1))
    charges = history(spark).filter(F.col("created") < "2019-07-01")
    revenue_run.run(charges, short, str(tmp_path), code_version="c1", run_id="r1")
    table = run_log.read_latest(spark, str(tmp_path), "evaluation").collect()
    assert {r["series_id"]: (r["model"], r["mase"]) for r in table} == {
        "league": ("croston", None), "recurring": ("level", None), "one_time": ("level", None)
    }
    for months in (12, 24):
        wide = run_log.read_latest(spark, str(tmp_path), f"forecast_{months}m").collect()
        assert len(wide) == months and all(r["total_base"] > 0 for r in wide)


def test_run_record(spark, published):
    root, charges, _ = published
    last = run_log.last_run(spark, f"{root}/runs")
    assert last["data_through"] == "2022-12-01" and last["rows_clean"] == 180
    assert last["input_fingerprint"] == run_log.fingerprint_text(charges)
    assert set(last["model_selections"]) == set(SETTINGS.streams) == set(last["metrics"])


def test_same_input_and_code_is_a_no_op(published):
    root, charges, _ = published
    assert revenue_run.run(charges, SETTINGS, root, code_version="c1", run_id="r2").skipped


def test_hard_regression_blocks_before_the_forecast(spark, published):
    root, charges, _ = published
    # A pattern that repeats exactly from year to year and is new: hard for every model, easy
    # for the benchmark.
    repeating = (500 + 3000 * ((F.month("created") * 7) % 12)).cast("double")
    worse = charges.withColumn(
        "amount",
        F.when(
            (F.col("description") == "Subscription update") & (F.col("created") >= "2021-01-01"),
            repeating,
        ).otherwise(F.col("amount")),
    )
    before = run_log.latest_version(spark, root, "forecast_12m")
    every = run_log.published_tables(spark, root)
    with pytest.raises(RegressionError):
        revenue_run.run(worse, SETTINGS, root, code_version="c1", run_id="r3")
    assert run_log.latest_version(spark, root, "forecast_12m") == before
    # No table moves, also not those that were staged before the gate.
    assert run_log.published_tables(spark, root) == every
    assert {run_log.latest_version(spark, root, name)[0] for name in every} == {"r1"}
    assert run_log.last_run(spark, f"{root}/runs")["run_id"] == "r1"


def test_invalid_input_stops_the_run(spark, published, tmp_path):
    _, charges, _ = published
    bad = charges.withColumn("created", F.lit(datetime(2099, 1, 1)).cast("timestamp_ntz"))
    with pytest.raises(ContractError, match="created_in_range"):
        revenue_run.run(bad, SETTINGS, str(tmp_path), code_version="c1")


def test_nothing_left_after_cleaning_stops_the_run(published, tmp_path):
    _, charges, _ = published
    with pytest.raises(ContractError, match="no rows survived"):
        revenue_run.run(
            charges.withColumn("status", F.lit("Refunded")), SETTINGS, str(tmp_path), code_version="c1"
        )


def test_any_column_can_name_the_series(spark, tmp_path):
    charges = history(spark).withColumn(
        "shop", F.concat(F.lit("shop-"), (F.dayofmonth("created") + F.month("created") % 2).cast("string"))
    )
    root = str(tmp_path)
    outcome = revenue_run.run(charges, SETTINGS, root, code_version="c1", by="shop")
    assert outcome.months == 72
    table = run_log.read_latest(spark, root, "evaluation").collect()
    assert {r["series_id"] for r in table} == {"shop-10", "shop-11"}
    total = run_log.read_latest(spark, root, "forecast_24m")
    assert total.count() == 24 and total.filter("bear <= base and base <= bull").count() == 24
    prior = run_log.prior_mase(spark, f"{root}/runs", root)
    assert prior.count() == 2


def test_horizons_share_their_beginning(spark, published):
    root, _, _ = published
    short = run_log.read_latest(spark, root, "forecast_12m")
    long = run_log.read_latest(spark, root, "forecast_24m")
    assert short.exceptAll(long).count() == 0


def test_raw_charges_are_read_once(first_run):
    *_, path, plans = first_run
    readers = [p for p in plans if f"[file:{path}]" in p]
    assert len(readers) == 1 and readers[0].count(f"[file:{path}]") == 1


def test_stored_series_are_not_moved_again(spark, published):
    root, _, _ = published
    arrays = run_log.read_latest(spark, root, "series_arrays")
    assert arrays.count() == 3
    frames = [
        backtest.backtest(arrays, revenue_run.CLOSED_FORM, SETTINGS),
        forecasters.forecast(arrays, "croston", 24, SETTINGS),
        monthly.to_long(arrays),
    ]
    for frame in frames:
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    long = run_log.read_latest(spark, root, "monthly_long")
    assert monthly.to_long(arrays).exceptAll(long).count() == 0 and long.count() == 3 * 72


def test_flags_that_do_not_count_are_published_too(spark, published):
    root, _, _ = published
    flagged = run_log.read_latest(spark, root, "flagged_months")
    counted = flagged.filter("outlier").select("series_id", "month")
    assert counted.exceptAll(run_log.read_latest(spark, root, "outliers")).count() == 0
    assert counted.count() == run_log.read_latest(spark, root, "outliers").count() <= flagged.count()
    assert all(r["count"] <= SETTINGS.most_outliers for r in counted.groupBy("series_id").count().collect())


def rows(spark, root, name):
    return sorted(map(str, run_log.read_latest(spark, root, name).collect()))


@pytest.mark.parametrize("stage", ["fit", "evaluate", "forecast"])
def test_a_rerun_of_a_stage_equals_the_full_run(spark, published, stage):
    root, charges, _ = published
    names = ("monthly_long", "outliers", "breaks", "backtests", "evaluation", "forecast_12m", "forecast_24m")
    before = {name: rows(spark, root, name) for name in names}
    given = {"charges": charges} if stage == "evaluate" else {}
    outcome = revenue_run.rerun(spark, stage, SETTINGS, root, "c1", run_id=f"again-{stage}", **given)
    assert (outcome.rows_in, outcome.rows_clean, outcome.months) == (324, 180, 72)
    assert {name: rows(spark, root, name) for name in names} == before
    tables = run_log.published_tables(spark, root)
    assert set(names) <= set(tables) and f"run_id=again-{stage}" in tables["forecast_24m"]
    assert (f"run_id=again-{stage}" in tables["evaluation"]) == (stage != "forecast")
    assert run_log.last_run(spark, f"{root}/runs")["run_id"] == f"again-{stage}"


def test_stale_tables_are_refused(spark, published, tmp_path):
    root, charges, _ = published
    with pytest.raises(run_log.StaleModelError, match="fit again"):
        revenue_run.rerun(spark, "forecast", SETTINGS, root, "c1", charges=charges.limit(300))
    other = Settings(as_of=date(2023, 1, 15), series_start=date(2018, 1, 1), cv_windows=2)
    with pytest.raises(run_log.StaleModelError, match="other settings"):
        revenue_run.rerun(spark, "evaluate", other, root, "c1")
    with pytest.raises(FileNotFoundError):
        revenue_run.rerun(spark, "fit", SETTINGS, str(tmp_path / "nothing"), "c1")
    with pytest.raises(ValueError, match="begins at"):
        revenue_run.rerun(spark, "data", SETTINGS, root, "c1")


def test_the_reduction_counts_what_the_contract_and_the_fingerprint_ask_for(spark):
    charges = history(spark).unionByName(spark.createDataFrame([(None, None, None, None, None)], CHARGE_DDL))
    cells = revenue_run.reduced(charges, SETTINGS)
    fingerprint, counted = revenue_run.inspect(cells, SETTINGS)
    assert fingerprint == run_log.fingerprint_text(charges)
    report = contracts.quality_report(charges, contracts.charge_rules(SETTINGS.as_of)).collect()
    assert [counted[f"n{i}"] for i in range(len(report))] == [r.failures for r in report]
    assert counted["rows"] == report[0].rows == 325
    nothing = charges.limit(0)
    assert revenue_run.inspect(revenue_run.reduced(nothing, SETTINGS), SETTINGS)[0] == run_log.fingerprint_text(nothing)


def test_a_run_takes_the_fresh_snapshot_before_the_history(spark, tmp_path):
    short = Settings(as_of=date(2019, 7, 15), series_start=date(2017, 1, 1), disruption_end=date(2017, 4, 1))
    names = {"status": "Status", "created": "Created date (UTC)", "amount": "Amount", "currency": "Currency", "description": "Description"}
    snapshot = history(spark).filter(F.col("created") < "2019-07-01").withColumnsRenamed(names)
    snapshot.coalesce(1).write.option("header", True).csv(str(tmp_path / "history"))
    candidates = [("snapshot", str(tmp_path / "absent")), ("history", str(tmp_path / "history"))]
    schema = "Status string, `Created date (UTC)` timestamp_ntz, Amount double, Currency string, Description string"
    root = str(tmp_path / "out")
    outcome = revenue_run.run_from(spark, candidates, schema, short, root, "c1", run_id="r1")
    assert outcome.rows_in == 135 and outcome.months == 30
    assert run_log.last_run(spark, f"{root}/runs")["input_source"] == "history"
    with pytest.raises(FileNotFoundError):
        revenue_run.run_from(spark, candidates[:1], schema, short, root, "c1")
