"""Selection, gates, drift and reporting tables on small worked examples."""

from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from cashtide.operators import drift, kpis, outlook, selection

SCORE_DDL = "series_id string, model string, mase double, rmse double, winkler80 double"


def selected(spark, rows):
    frame = spark.createDataFrame([(*r, 1.0, 1.0) for r in rows], SCORE_DDL)
    rank = selection.preference(F.col("series_id"), F.col("model"), selection.DEFAULT_PAIRS)
    return {r["series_id"]: r["model"] for r in selection.select_model(frame, rank).collect()}


def test_challenger_must_be_strictly_better(spark):
    got = selected(
        spark,
        [
            ("league", "ensemble", 0.8), ("league", "croston", 0.8), ("league", "level", 0.1),
            ("recurring", "ensemble", 0.8), ("recurring", "level", 0.7),
            ("one_time", "level", 0.9), ("one_time", "ensemble", None),
        ],
    )
    assert got == {"league": "ensemble", "recurring": "level", "one_time": "level"}


def test_undefined_scores_keep_the_default(spark):
    got = selected(spark, [("one_time", "level", None), ("one_time", "ensemble", None)])
    assert got == {"one_time": "level"}


EVAL_DDL = "series_id string, mase double, baseline_mase double"


def test_regression_verdicts(spark):
    table = spark.createDataFrame(
        [("hard", 1.4, 1.0), ("soft", 1.4, 2.0), ("ok", 1.3, 1.0), ("none", 1.4, 1.0), ("zero", 1.4, 1.0),
         ("undefined", None, 1.0), ("unknown_base", 1.4, None)],
        EVAL_DDL,
    )
    prior = spark.createDataFrame(
        [("hard", 1.0), ("soft", 1.0), ("ok", 1.0), ("zero", 0.0), ("undefined", 1.0), ("unknown_base", 1.0)],
        "series_id string, prior_mase double",
    )
    verdicts = {r["series_id"]: r["verdict"] for r in selection.regression_report(table, prior).collect()}
    assert verdicts == {
        "hard": "hard", "soft": "soft", "ok": "ok", "none": "skipped", "zero": "skipped",
        "undefined": "skipped", "unknown_base": "soft",
    }
    with pytest.raises(selection.RegressionError, match="hard from 1.000 to 1.400"):
        selection.regression_gate(table, prior)
    soft = selection.regression_gate(table.filter("series_id <> 'hard'"), prior)
    assert soft.count() == 2
    assert selection.regression_gate(table, None).count() == 0


def test_grades(spark):
    table = spark.createDataFrame(
        [("a", "m", 0.9, 10.0, 1.0, True), ("b", "m", 1.4, 10.0, 1.5, True), ("c", "m", 1.2, 10.0, 1.0, False),
         ("d", "m", 1.6, 10.0, 1.0, False)],
        "series_id string, model string, mase double, rmse double, baseline_mase double, beats_baseline boolean",
    )
    averages = spark.createDataFrame([("a", 50.0), ("b", None)], "series_id string, mean_positive double")
    rows = {r["series_id"]: r for r in selection.accuracy_grade(table, averages).collect()}
    assert [rows[k]["grade"] for k in "abcd"] == [
        "beats benchmark", "beats benchmark", "near benchmark", "trajectory only",
    ]
    assert [rows[k]["strong"] for k in "abcd"] == [True, False, False, False]
    assert rows["a"]["error_pct"] == 20.0 and rows["b"]["error_pct"] == 1000.0
    assert rows["a"]["gap_pct"] == pytest.approx(10.0) and rows["c"]["gap_pct"] == pytest.approx(20.0)
    assert selection.beats_summary(table).first().asDict() == {"beating": 2, "models": 4}


def plain_psi(reference, current):
    values = set(reference) | set(current)
    share = lambda xs, v: max(xs.count(v) / len(xs), 1e-6)
    return sum(
        (share(current, v) - share(reference, v)) * math.log(share(current, v) / share(reference, v))
        for v in values
    )


def test_psi_over_shared_values(spark):
    reference, current = [1, 1, 2, 3, 3, 3], [1, 3, 4, 4]
    rows = [("reference", str(v)) for v in reference] + [("current", str(v)) for v in current]
    rows.append(("current", None))
    frame = spark.createDataFrame(rows, "period string, v string")
    row = drift.psi(frame, ("v",)).first()
    assert row["psi"] == pytest.approx(plain_psi(reference, current))
    assert (row["values"], row["reference_rows"], row["current_rows"]) == (4, 6, 4)
    counted = frame.groupBy("period", "v").agg(F.count("*").alias("n"))
    assert drift.psi(counted, ("v",), weight="n").first()["psi"] == pytest.approx(row["psi"])


def test_drift_report_counts_drifted_columns(spark):
    scores = spark.createDataFrame([("a", 0.2), ("b", 0.1)], "column string, psi double")
    rows = {r["column"]: r for r in drift.drift_report(scores).collect()}
    assert rows["a"]["drifted"] and not rows["b"]["drifted"]
    assert (rows["a"]["drifted_columns"], rows["b"]["drifted_share"]) == (1, 0.5)


def test_served_horizon_is_a_prefix_of_the_stored_forecast(spark):
    total = spark.createDataFrame(
        [(s, date(2021, s, 1), 10.0 * s, 8.0, 12.0, 7.0, 13.0) for s in range(1, 7)],
        "step int, month date, total double, lo80 double, hi80 double, lo95 double, hi95 double",
    )
    asked = spark.createDataFrame([(1, 3, 80), (2, 2, 95)], "request_id int, horizon int, level int")
    rows = outlook.score_requests(asked, total).orderBy("request_id", "step").collect()
    assert [(r["request_id"], r["step"], r["yhat"], r["lo"], r["hi"]) for r in rows] == [
        (1, 1, 10.0, 8.0, 12.0), (1, 2, 20.0, 8.0, 12.0), (1, 3, 30.0, 8.0, 12.0),
        (2, 1, 10.0, 7.0, 13.0), (2, 2, 20.0, 7.0, 13.0),
    ]


def line_of(spark, actual, planned, start=date(2020, 1, 1)):
    month = lambda i: date(start.year + (start.month - 1 + i) // 12, (start.month - 1 + i) % 12 + 1, 1)
    rows = [("s", month(i), "actual", float(v), None, None) for i, v in enumerate(actual)]
    rows += [
        ("s", month(len(actual) + i), "forecast", float(v), float(v) - 1, float(v) + 1)
        for i, v in enumerate(planned)
    ]
    return spark.createDataFrame(
        rows, "series_id string, month date, kind string, y double, bear double, bull double"
    )


def test_year_to_date(spark):
    row = kpis.ytd_tracker(line_of(spark, range(1, 16), [100] * 12)).first()
    # Actuals run to March 2021: 13 + 14 + 15 this year, 1 + 2 + 3 in the same months of 2020.
    assert (row["year"], row["ytd_months"], row["ytd_actual"], row["prior_ytd"]) == (2021, 3, 42.0, 6.0)
    assert (row["remaining"], row["full_year"], row["yoy_pct"]) == (900.0, 942.0, 600.0)
    first_year = kpis.ytd_tracker(line_of(spark, [1, 2], [5])).first()
    assert (first_year["prior_ytd"], first_year["yoy_pct"]) == (0.0, 0.0)


def test_horizon_against_last_year(spark):
    row = kpis.vs_prior_year(line_of(spark, [10] * 12 + [20] * 3, [11] * 12)).first()
    assert (row["prior_year"], row["base"], row["spread"]) == (120.0, 132.0, 24.0)
    assert row["pct_vs_prior"] == pytest.approx(10.0)


def test_stream_health_and_kpi(spark):
    line = line_of(spark, [1] * 6 + [10] * 6 + [12] * 6, [20] * 14)
    row = kpis.stream_health(line).first()
    assert (row["recent6_mean"], row["prior6_mean"], row["last12"], row["next12"]) == (12.0, 10.0, 132.0, 240.0)
    assert row["status"] == "Growing" and row["momentum_pct"] == pytest.approx(20.0)
    kpi = kpis.stream_kpi(line).first()
    assert (kpi["forecast_sum"], kpi["forecast_mean"], kpi["last12_mean"]) == (280.0, 20.0, 11.0)
    assert kpis.stream_health(line_of(spark, [10] * 12, [9.6] * 12)).first()["status"] == "Stable"
    assert kpis.stream_health(line_of(spark, [10] * 12, [9.4] * 12)).first()["status"] == "Declining"


def test_bridge_starts_with_the_last_actual(spark):
    rows = kpis.history_bridge(line_of(spark, [1, 2, 3], [7, 8])).orderBy("month").collect()
    assert [(r["kind"], r["y"]) for r in rows] == [("actual", 3.0), ("forecast", 7.0), ("forecast", 8.0)]


def test_monthly_growth_ignores_zero_divisors(spark):
    history = line_of(spark, [9, 0, 10, 20, 20, 30], []).select("series_id", "month", "y")
    # Changes within the last six: 9->0 is -100 %, 0->10 has none, then +100 %, 0 %, +50 %.
    assert kpis.mom_growth(history).first()["mom_growth_pct"] == pytest.approx(12.5)


def test_quarters_peak_bands_and_caution(spark):
    rows = [(i, date(2021, 1 + i, 1), float(b), float(b) - i, float(b) + i) for i, b in enumerate([5, 9, 9, 4, 4], 1)]
    total = spark.createDataFrame(rows, "step int, month date, base double, bear double, bull double")
    assert kpis.quarterly_scenarios(total).count() == 2
    full = kpis.quarterly_scenarios(total, full_only=True).collect()
    assert [(r["quarter"], r["base"]) for r in full] == [(2, 17.0)]
    caution = kpis.trend_caution(total).first()
    assert caution["declining"] and caution["last_base"] == 4.0
    peak = kpis.peak_month(
        total.select(F.lit("s").alias("series_id"), "month", F.col("base").alias("yhat"))
    ).first()
    assert peak["peak_month"] == date(2021, 3, 1)
    bands = {r["period"]: r for r in kpis.spread_bands(total).collect()}
    assert [bands[f"2021-0{m}-01"]["band"] for m in range(2, 7)] == ["low", "medium", "medium", "high", "high"]
    assert bands["TOTAL"]["spread"] == 30.0 and bands["TOTAL"]["band"] == "high"
    assert kpis.cumulative_scenarios(total).orderBy("month").collect()[-1]["base_cum"] == 31.0


def test_latest_month_split(spark):
    rows = [(s, date(2020 + i // 12, i % 12 + 1, 1), v + i) for s, v in (("a", 10.0), ("b", 30.0)) for i in range(13)]
    history = spark.createDataFrame(rows, "series_id string, month date, y double")
    row = kpis.latest_month(history, ["a", "b"]).first()
    assert (row["month"], row["total"], row["year_ago"]) == (date(2021, 1, 1), 64.0, 40.0)
    assert row["yoy_pct"] == pytest.approx(60.0) and row["a_pct"] == pytest.approx(22 / 64 * 100)


def test_requests_the_forecast_cannot_answer_are_not_accepted(spark):
    from cashtide.operators.contracts import forecast_contract

    months = [(s, date(2021, s, 1), 1.0, 0.5, 1.5, 0.25, 2.0) for s in (1, 2)]
    total = spark.createDataFrame(
        months, "step int, month date, total double, lo80 double, hi80 double, lo95 double, hi95 double"
    )
    requests = spark.createDataFrame([(1, 2, 80), (2, 5, 80), (3, 0, 95), (4, 30, 95)], "request_id int, horizon int, level int")
    judged = forecast_contract(outlook.score_requests(requests, total)).collect()
    assert {r["request_id"]: r["accepted"] for r in judged} == {1: True, 2: False, 3: False, 4: False}
