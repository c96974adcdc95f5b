"""The serving plan, version requests, drift of continuous columns, typed snapshots, empty files."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashtide.operators import contracts, drift, outlook
from cashtide.sources import charge_feed, run_log, tables

TOTAL = "step int, month date, total double, lo80 double, hi80 double, lo95 double, hi95 double"
REQUESTS = "request_id long, horizon int, level int"


def forecast(spark, change=lambda step, row: row, months=24):
    rows = [change(i, (i, date(2024 + i // 12, i % 12 + 1, 1), 100.0 + i, 90.0, 110.0 + i, 80.0, 130.0 + i)) for i in range(1, months + 1)]
    return spark.createDataFrame([r for r in rows if r], TOTAL)


def test_serving_answers_what_scoring_answers(spark):
    requests = spark.createDataFrame([(1, 3, 80), (2, 24, 95), (3, 1, None), (4, 0, 80), (5, 25, 80), (6, 3, 90), (7, None, 80)], REQUESTS)
    answers, refused = outlook.serve(requests, forecast(spark))
    good = contracts.split_valid(contracts.with_default_level(requests), contracts.request_rules())[0]
    columns = ["request_id", "horizon", "level", "step", "month", "yhat", "lo", "hi"]
    want = outlook.score_requests(good, forecast(spark)).select(*columns)
    assert sorted(answers.select(*columns).collect()) == sorted(want.collect()) and answers.count() == 28
    assert {r.request_id: r.reasons for r in refused.collect()} == {
        4: ["horizon_in_range"], 5: ["horizon_in_range"], 6: ["level_offered"], 7: ["horizon_in_range"]
    }
    plan = answers._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in plan and "Join" not in plan


def test_more_columns_only_where_they_are_named(spark):
    requests = spark.createDataFrame([(1, 2, 80, "x")], f"{REQUESTS}, asked_by string")
    with pytest.raises(contracts.ContractError, match="asked_by"):
        outlook.serve(requests, forecast(spark))
    assert outlook.serve(requests, forecast(spark), keep=("asked_by",))[0].first().asked_by == "x"


def spoil(position, value):
    return lambda step, row: (*row[:position], value, *row[position + 1 :]) if step == 5 else row


@pytest.mark.parametrize(
    "change, said",
    [
        (lambda step, row: None if step == 5 else row, "months missing"),
        (lambda step, row: (4, *row[1:]) if step == 5 else row, "months missing or repeated"),
        (spoil(2, None), "values missing"),
        (spoil(4, float("inf")), "infinite"),
        (spoil(3, float("nan")), "infinite"),
        (spoil(2, -0.5), "negative"),
        (spoil(3, 500.0), "bounds crossed"),
    ],
)
def test_a_wrong_forecast_fails_the_answers_that_need_it(spark, change, said):
    requests = lambda horizon: spark.createDataFrame([(77, horizon, 80)], REQUESTS)
    with pytest.raises(Exception, match=f"request 77: .*{said}"):
        outlook.serve(requests(6), forecast(spark, change))[0].collect()
    # Refusal is not pruned away when no value is asked for.
    with pytest.raises(Exception, match="request 77"):
        outlook.serve(requests(6), forecast(spark, change))[0].select("request_id").collect()
    assert outlook.serve(requests(3), forecast(spark, change))[0].count() == 3


def test_a_short_or_missing_forecast_fails(spark):
    requests = spark.createDataFrame([(1, 20, 95)], REQUESTS)
    for total in (forecast(spark, months=12), forecast(spark).limit(0)):
        with pytest.raises(Exception, match="months missing"):
            outlook.serve(requests, total)[0].collect()
    assert outlook.serve(requests.limit(0), forecast(spark))[0].count() == 0


VERSIONS = "model string, version int, contract string, alias string, run_id string"


def test_requests_are_resolved_together_as_one_by_one(spark):
    rows = [("m", 1, "v1", None, "r1"), ("m", 3, "v1", "champion", "r3"), ("m", 7, "v0", "champion", "r7"), ("m", 9, None, None, "r9"),
            ("n", 3, "v1", "latest", "s3"), ("n", 4, "v2", "17", "s4"), ("o", 17, None, "Champion", "t17")]
    versions = spark.createDataFrame(rows, VERSIONS)
    asked = ["latest", "LATEST", "champion", "9", "09", "17", "99999999999", "nobody", ""]
    requests = spark.createDataFrame([(x,) for x in [*asked, *asked, None]], "request string")
    got = run_log.resolve_requests(versions, requests, "v1")
    want = [
        (x, r.model, r.version, r.run_id) for x in asked for r in run_log.resolve_versions(versions, F.lit(x), "v1").collect()
    ]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 8
    named = spark.createDataFrame([("latest", "n"), ("latest", "x"), ("champion", "m"), ("9", "n")], "request string, model string")
    assert sorted(map(tuple, run_log.resolve_requests(versions, named, "v1").collect())) == [
        ("champion", "m", 7, "r7"), ("latest", "n", 3, "s3")
    ]
    assert run_log.resolve_requests(versions.limit(0), requests, "v1").count() == 0


def samples(spark, reference, current):
    rows = [("reference", *map(float, r)) for r in reference] + [("current", *map(float, r)) for r in current]
    return spark.createDataFrame(rows, "period string, a double, b double").repartition(4)


def by_numpy(reference, current, bins=10):
    ordered = np.sort(reference)
    edges = np.unique(ordered[[int(np.ceil(i / bins * len(ordered))) - 1 for i in range(1, bins)]])
    shares = [np.maximum(np.bincount(np.searchsorted(edges, x, side="left"), minlength=len(edges) + 1) / len(x), 1e-6) for x in (reference, current)]
    return float(((shares[1] - shares[0]) * np.log(shares[1] / shares[0])).sum())


def test_two_halves_of_one_sample_do_not_drift(spark):
    rng = np.random.default_rng(3)
    one, two = rng.normal(size=(3000, 2)), rng.normal(size=(3000, 2))
    two[:, 1] += 1.0
    found = {r.column: r for r in drift.psi_binned(samples(spark, one, two), ("a", "b")).collect()}
    assert found["a"].psi < 0.1 < 0.2 < found["b"].psi and found["a"].bins == 10
    for i, name in enumerate("ab"):
        assert found[name].psi == pytest.approx(by_numpy(one[:, i], two[:, i]), abs=1e-9)
    exact = {r.column: r.psi for r in drift.psi(samples(spark, one, two), ("a",)).collect()}
    assert exact["a"] > 10  # what exact values make of it


def test_bins_of_ties_missing_values_and_nothing(spark):
    one = [(0, 1)] * 95 + [(5, 2)] * 5
    rows = samples(spark, one, one).unionByName(spark.createDataFrame([("current", None, float("nan"))], "period string, a double, b double"))
    found = {r.column: r for r in drift.psi_binned(rows, ("a", "b")).collect()}
    assert (found["a"].bins, found["a"].psi, found["a"].current_rows) == (2, 0.0, 100)
    assert found["b"].current_rows == 101 and found["b"].psi > 0
    lonely = drift.psi_binned(rows.where("period = 'current'"), ("a",)).collect()
    assert [(r.bins, r.reference_rows, r.current_rows) for r in lonely] == [(1, 0, 100)]
    assert drift.psi_binned(rows.limit(0), ("a",)).count() == 0


def test_flattened_and_minimised_charges_have_one_schema(spark):
    flat = charge_feed.flatten_charges(spark.createDataFrame([], charge_feed.CHARGE_SCHEMA))
    least = charge_feed.minimise(spark.createDataFrame([("x",)], "id string"))
    kinds = lambda frame: [(f.name, f.dataType.simpleString()) for f in frame.schema]
    assert kinds(least) == kinds(flat) and flat.union(least).count() == 1


def test_a_csv_without_a_header_is_an_empty_optional_table(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    frame = tables.read_optional(spark, str(tmp_path / "empty.csv"), "a int, b string", "csv")
    assert frame.columns == ["a", "b"] and frame.isEmpty()
    (tmp_path / "header.csv").write_text("b,a\n")
    assert tables.read_optional(spark, str(tmp_path / "header.csv"), "a int, b string", "csv").isEmpty()
    (tmp_path / "other.csv").write_text("b\n1\n")
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_optional(spark, str(tmp_path / "other.csv"), "a int, b string", "csv")
