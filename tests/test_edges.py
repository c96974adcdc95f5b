from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from cashtide import Settings
from cashtide.functions.categories import stream_of
from cashtide.operators import forecasters, outlook, scores, selection
from cashtide.sources import run_log

SETTINGS = Settings(as_of=date(2021, 1, 15), series_start=date(2018, 1, 1))


@pytest.mark.parametrize("text", [" Subscription update ", "\x1cSubscription creation\x85", "Subscription update"])
def test_white_space_of_any_kind_is_trimmed(spark, text):
    assert spark.createDataFrame([(text,)], "d string").select(stream_of(F.col("d"))).first()[0] == "recurring"


@pytest.mark.parametrize(
    "default, challenger, kept",
    [(None, 0.5, "a"), (0.5, None, "a"), (None, None, "a"), (0.5, 0.5, "a"), (0.5, 0.4, "b")],
)
def test_undefined_mase_keeps_the_default(spark, default, challenger, kept):
    scored = spark.createDataFrame(
        [("s", "a", default, 1.0, 1.0), ("s", "b", challenger, 1.0, 1.0)],
        "series_id string, model string, mase double, rmse double, winkler80 double",
    )
    chosen = selection.select_model(scored, selection.ranked_by(F.col("model"), ("a", "b"))).first()
    assert chosen["model"] == kept


def test_other_settings_are_another_run():
    prior = {"input_fingerprint": "f", "code_version": "c", "settings_digest": run_log.settings_digest("a", 1)}
    assert run_log.unchanged(prior, "f", "c", run_log.settings_digest("a", 1))
    assert not run_log.unchanged(prior, "f", "c", run_log.settings_digest("a", 2))


def test_normality_tests_no_part_of_the_residuals(spark):
    rows = spark.createDataFrame(
        [("s", "m", [0.1, -0.4, 0.3, 0.9, -1.2]), ("t", "m", [0.1, -0.4, 0.3, 0.9, -1.2, 0.7])],
        "series_id string, model string, residuals array<double>",
    )
    found = {r["series_id"]: r["shapiro_p"] for r in scores.normality(rows, limit=5).collect()}
    assert found["s"] is not None and found["t"] is None


def test_a_series_without_demand_has_the_rate_zero(spark):
    demand = spark.createDataFrame([("none", 3, None), ("one", 2, 12.0)], "series_id string, idx int, y double")
    bounded = forecasters.with_bounds(forecasters.croston_rates(demand, F.lit(24)))
    found = {r["series_id"]: r.asDict() for r in bounded.collect()}
    assert {k: found["none"][k] for k in ("demand_months", "rate", "spread", "lo80", "hi95")} == dict.fromkeys(
        ("demand_months", "rate", "spread", "lo80", "hi95"), 0
    )
    assert found["one"]["rate"] == pytest.approx(0.5)


def test_every_series_gets_a_forecast_however_short(spark):
    lengths = {"one": 1, "some": 20, "below": 35, "enough": 36, "idle": 36}
    rows = [
        (name, date(2018, 1, 1), [0.0 if name == "idle" else 10.0 + i for i in range(n)]) for name, n in lengths.items()
    ]
    arrays = spark.createDataFrame(rows, "series_id string, first_month date, ys array<double>")
    scored = spark.createDataFrame(
        [("enough", "croston", 0.5, True)], "series_id string, model string, mase double, beats_baseline boolean"
    )
    table = selection.for_every_series(scored, arrays)
    found = {r["series_id"]: (r["model"], r["mase"], r["beats_baseline"]) for r in table.collect()}
    assert found == {
        "one": ("level", None, False),
        "some": ("level", None, False),
        "below": ("level", None, False),
        "enough": ("croston", 0.5, True),
        "idle": ("croston", None, False),
    }
    forecast = outlook.forecast_by_model(arrays, table, 24, SETTINGS).collect()
    assert {name: sum(r["series_id"] == name for r in forecast) for name in lengths} == dict.fromkeys(lengths, 24)
    assert all(r["yhat"] is not None and r["yhat"] >= 0 for r in forecast)
    assert {r["yhat"] for r in forecast if r["series_id"] == "idle"} == {0.0}
