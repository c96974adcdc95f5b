"""Closed-form forecasters against values worked out by hand or by a plain loop."""

from __future__ import annotations

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashtide import Settings
from cashtide.functions import folds
from cashtide.operators import backtest as bt
from cashtide.operators import forecasters, outlook, robust, scores

CALM = Settings(as_of=date(2030, 1, 1), series_start=date(2015, 1, 1), disruption_end=date(2015, 3, 1))


def fold(spark, values, expression):
    frame = spark.createDataFrame([([float(v) for v in values],)], "ys array<double>")
    return frame.select(expression(F.col("ys"))).first()[0]


def rate_of(ys):
    return folds.croston_rate(folds.demand_points(ys), F.size(ys))


def slow_croston(values, alpha=0.15):
    at = [i for i, v in enumerate(values) if v > 0]
    if len(at) < 2:
        return sum(values) / len(values)
    size, gap, last = values[at[0]], at[0], at[0]
    for i in at[1:]:
        size = alpha * values[i] + (1 - alpha) * size
        gap = alpha * (i - last) + (1 - alpha) * gap
        last = i
    return size / gap if gap > 0 else size


@pytest.mark.parametrize(
    "values",
    [[0, 5, 0, 7, 9], [0, 0, 0, 0], [0, 0, 8, 0], [5, 6, 7], [5, 0], [3, 0, 0, 9, 0, 0, 0, 4]],
)
def test_croston_rate(spark, values):
    assert fold(spark, values, rate_of) == pytest.approx(slow_croston(values), abs=1e-12)


def test_croston_worked_example(spark):
    assert fold(spark, [0, 5, 0, 7, 9], rate_of) == pytest.approx(5.19290465631929)


def test_croston_from_demand_months_equals_the_filled_series(spark):
    values = [0, 5, 0, 7, 9, 0]
    demand = spark.createDataFrame(
        [("a", i, float(v)) for i, v in enumerate(values) if v], "series_id string, idx int, y double"
    )
    row = forecasters.croston_rates(demand, F.lit(len(values))).first()
    assert row["rate"] == pytest.approx(slow_croston(values))
    assert row["spread"] == pytest.approx(np.std([5, 7, 9]))
    bounded = forecasters.with_bounds(forecasters.croston_rates(demand, F.lit(6))).first()
    assert bounded["lo80"] == pytest.approx(max(row["rate"] - 1.28 * row["spread"], 0))
    assert bounded["hi95"] == pytest.approx(row["rate"] + 1.96 * row["spread"])


def test_decayed_level(spark):
    values = np.array([4.0, 8.0, 6.0])
    weights = 0.75 ** np.arange(2, -1, -1)
    assert fold(spark, values, folds.decayed_level) == pytest.approx((values * weights).sum() / weights.sum())
    assert fold(spark, [], folds.decayed_level) == 0.0


def one_path(frame, expression):
    return [r.asDict() for r in frame.select(F.inline(expression)).collect()]


def test_baselines(make_arrays):
    values = list(range(1, 31))
    arrays = make_arrays({"a": values})
    naive = one_path(arrays, forecasters.seasonal_naive_path(F.col("ys"), 14, CALM))
    assert [p["yhat"] for p in naive] == [*range(19, 31), 19, 20]
    drift = one_path(arrays, forecasters.drift_path(F.col("ys"), 3, CALM))
    assert [p["yhat"] for p in drift] == [31, 32, 33]
    mean = one_path(arrays, forecasters.mean_path(F.col("ys"), 1, CALM))
    assert mean[0]["yhat"] == 15.5
    assert all(mean[0][bound] is None for bound in ("lo80", "hi80", "lo95", "hi95"))
    assert naive[0]["hi80"] - naive[0]["yhat"] == pytest.approx(1.28 * 12)
    assert naive[12]["hi80"] - naive[12]["yhat"] == pytest.approx(1.28 * 12 * math.sqrt(2))


def test_forecast_months_follow_the_series(make_arrays):
    arrays = make_arrays({"a": [1.0] * 14}, first_month=date(2020, 1, 1))
    months = [r["month"] for r in forecasters.forecast(arrays, "mean", 2, CALM).orderBy("step").collect()]
    assert months == [date(2021, 3, 1), date(2021, 4, 1)]


def level_of(arrays, outlier_months):
    spark = arrays.sparkSession
    outliers = spark.createDataFrame(
        [("a", m) for m in outlier_months], "series_id string, month date"
    )
    marked = forecasters.with_outlier_positions(arrays, outliers)
    return forecasters.level_forecast(marked, 1, CALM).first()


def expected_level(values):
    weights = 0.75 ** np.arange(len(values) - 1, -1, -1)
    return float(np.dot(values, weights) / weights.sum())


def test_level_leaves_out_disruption_outliers_and_empty_months(make_arrays):
    # January and February lie before the end of the disruption.
    arrays = make_arrays({"a": [50, 60, 10, 0, 20, 900, 30]})
    row = level_of(arrays, [date(2015, 6, 1)])
    assert row["yhat"] == pytest.approx(expected_level([10, 20, 30]))
    assert row["hi80"] - row["yhat"] == pytest.approx(1.28 * np.std([10, 20, 30]))


def test_level_falls_back_to_outliers_then_to_all_positive(make_arrays):
    too_few = level_of(make_arrays({"a": [50, 60, 10, 20, 900]}), [date(2015, 5, 1)])
    assert too_few["yhat"] == pytest.approx(expected_level([10, 20, 900]))
    all_positive = level_of(make_arrays({"a": [50, 60, 10]}), [])
    assert all_positive["yhat"] == pytest.approx(expected_level([50, 60, 10]))
    nothing = level_of(make_arrays({"a": [0, 0, 0]}), [])
    assert (nothing["yhat"], nothing["lo80"], nothing["hi80"]) == (0.0, 0.0, 0.0)


def test_floor_lifts_points_only(make_arrays):
    arrays = make_arrays({"a": [100.0] * 18 + [0.0, 40.0], "b": [9.0] + [0.0] * 18})
    assert {r[0]: r[1] for r in arrays.select("series_id", forecasters.recent_floor(F.col("ys"))).collect()} == {
        "a": 25.0,
        "b": 0.0,
    }
    low = F.array(
        F.struct(
            F.lit(1).alias("step"),
            *[F.lit(v).alias(n) for n, v in (("yhat", 1.0), ("lo80", 0.5), ("hi80", 2.0), ("lo95", 0.1), ("hi95", 3.0))],
        )
    )
    path = one_path(arrays.filter("series_id = 'a'"), forecasters.apply_floor(low, F.col("ys")))
    assert (path[0]["yhat"], path[0]["lo80"], path[0]["hi80"]) == (25.0, 0.5, 2.0)


def member(values):
    names = ("yhat", "lo80", "hi80", "lo95", "hi95")
    return F.array(F.struct(F.lit(1).alias("step"), *[F.lit(float(v)).alias(n) for n, v in zip(names, values)]))


def test_combination_clips_and_takes_median_or_mean(spark):
    a, b, c = member([1, -4, 5, -9, 9]), member([2, -1, 7, -2, 12]), member([9, 3, 999, 1, 9999])
    frame = spark.range(1)
    median = one_path(frame, forecasters.combine_paths(a, b, c, "median"))[0]
    assert (median["yhat"], median["lo80"], median["hi80"], median["hi95"]) == (4.0, 0.0, 7.0, 12.0)
    mean = one_path(frame, forecasters.combine_paths(a, b, c, "mean"))[0]
    assert mean["lo80"] == pytest.approx(-2 / 3) and mean["hi80"] == pytest.approx(337.0)


def test_cv_windows_end_with_the_series(make_arrays):
    arrays = make_arrays({"long": list(range(79)), "short": list(range(40)), "tiny": list(range(30))})
    windows = bt.cv_windows(arrays, CALM).select("series_id", "train_end", "test_end", "ys", "actual").collect()
    ends = {}
    for w in windows:
        ends.setdefault(w["series_id"], []).append(w["train_end"])
        assert w["ys"] == [float(v) for v in range(w["train_end"])]
        assert w["actual"] == [float(v) for v in range(w["train_end"], w["test_end"])]
    assert sorted(ends["long"]) == [46, 49, 52, 55, 58, 61, 64, 67]
    assert sorted(ends["short"]) == [25, 28]
    assert "tiny" not in ends


def test_mase_scale_uses_the_full_series(make_arrays):
    values = [float(i % 12) + (5 if i >= 30 else 0) for i in range(48)]
    arrays = make_arrays({"a": values, "short": values[:12], "flat": [3.0] * 40})
    got = {r[0]: r[1] for r in arrays.select("series_id", bt.mase_scale(F.col("ys"), CALM)).collect()}
    assert got["a"] == pytest.approx(np.mean(np.abs(np.array(values[12:]) - np.array(values[:-12]))))
    assert got["short"] is None and got["flat"] is None


def test_backtest_models_match_a_plain_loop(make_arrays):
    rng = np.random.default_rng(3)
    values = np.round(rng.uniform(0, 100, 60) * (rng.random(60) > 0.4), 2)
    rows = bt.backtest(make_arrays({"a": values}), ("croston", "level", "seasonal_naive"), CALM).collect()
    for r in rows:
        train = values[: r["train_end"]]
        if r["model"] == "croston":
            expected = slow_croston(list(train))
        elif r["model"] == "seasonal_naive":
            expected = train[-(12 - ((r["step"] - 1) % 12))]
        else:
            expected = expected_level(train[2:][train[2:] > 0])
        assert r["yhat"] == pytest.approx(expected)
        assert r["y"] == values[r["train_end"] + r["step"] - 1]
        assert (r["lo80"] is None) == (r["model"] != "level")


def test_scores_by_hand(spark):
    rows = [("a", "m", 24, 1, 10.0, 12.0, 8.0, 11.0, 4.0), ("a", "m", 24, 2, 20.0, 16.0, 10.0, 18.0, 4.0)]
    frame = spark.createDataFrame(
        rows,
        "series_id string, model string, train_end int, step int, y double, yhat double, "
        "lo80 double, hi80 double, scale double",
    )
    row = scores.score(frame).first()
    assert row["mase"] == pytest.approx(3.0 / 4.0)
    assert row["rmse"] == pytest.approx(math.sqrt(10.0))
    # Widths 3 and 8; the second actual lies 2 above its interval and costs 10 x 2.
    assert row["winkler80"] == pytest.approx((3 + 8 + 20) / 2)


def test_forecast_by_model_takes_the_chosen_path(make_arrays):
    arrays = make_arrays({"a": [5.0] * 30, "b": list(range(30)), "c": [1.0] * 30})
    chosen = arrays.sparkSession.createDataFrame(
        [("a", "level"), ("b", "seasonal_naive")], "series_id string, model string"
    )
    rows = outlook.forecast_by_model(arrays, chosen, 2, CALM).collect()
    got = {(r["series_id"], r["step"]): r["yhat"] for r in rows}
    assert got == {("a", 1): 5.0, ("a", 2): 5.0, ("b", 1): 18.0, ("b", 2): 19.0}


def test_totals_add_bounds_and_refuse_partial_sums(spark):
    rows = [("a", 1, date(2021, 1, 1), 5.0, 4.0, 6.0, 3.0, 7.0), ("b", 1, date(2021, 1, 1), 1.0, None, 2.0, 0.0, 3.0)]
    frame = spark.createDataFrame(
        rows,
        "series_id string, step int, month date, yhat double, lo80 double, hi80 double, lo95 double, hi95 double",
    )
    row = outlook.total_forecast(frame).first()
    assert (row["total"], row["base"], row["bull"], row["lo95"]) == (6.0, 6.0, 8.0, 3.0)
    assert row["bear"] is None


def hampel_by_loop(values, width, n_sigma):
    half, n = width // 2, len(values)
    median = lambda v, i: float(np.median(v[max(0, i - half) : i + half + 1]))
    deviation = [abs(values[i] - median(values, i)) for i in range(n)]
    return [deviation[i] > n_sigma * 1.4826 * median(deviation, i) for i in range(n)]


def test_hampel_uses_each_months_own_median(make_arrays, spark):
    rng = np.random.default_rng(5)
    values = list(np.round(rng.normal(100, 5, 60), 2))
    values[20], values[40] = 300.0, 1.0
    from cashtide.operators.monthly import to_long

    flags = robust.hampel_flags(to_long(make_arrays({"a": values})), n_sigma=3.0)
    got = [r["flagged"] for r in flags.orderBy("month").collect()]
    assert got == hampel_by_loop(values, 5, 3.0)
    assert got[20] and got[40]


def test_only_flags_among_the_largest_values_survive(spark):
    rows = [("a", date(2020, m, 1), float(v), f) for m, v, f in
            [(1, 10, True), (2, 90, False), (3, -80, True), (4, 70, True), (5, 5, False)]]
    frame = spark.createDataFrame(rows, "series_id string, month date, y double, flagged boolean")
    kept = robust.keep_strongest(frame, limit=2).filter("outlier").collect()
    # Three flags exceed the limit; of the two largest values one is not flagged.
    assert [r["y"] for r in kept] == [-80.0]
    assert robust.keep_strongest(frame, limit=3).filter("outlier").count() == 3


def test_indicators_and_steps(spark):
    rows = [("a", date(2020, m, 1), 1.0) for m in (1, 2, 3)]
    long = spark.createDataFrame(rows, "series_id string, month date, y double")
    marks = spark.createDataFrame([("a", date(2020, 2, 1))], "series_id string, month date")
    hits = robust.outlier_indicators(long, marks).orderBy("month").collect()
    assert [r["indicator"] for r in hits] == [0, 1, 0]
    wide = robust.indicator_columns(long, [date(2020, 2, 1)]).orderBy("month").collect()
    assert [r["outlier_202002"] for r in wide] == [0.0, 1.0, 0.0]
    steps = robust.step_dummy(long, robust.first_break(marks)).orderBy("month").collect()
    assert [r["post_break"] for r in steps] == [0.0, 1.0, 1.0]
    none = robust.step_dummy(long, robust.first_break(marks.limit(0))).collect()
    assert all(r["post_break"] is None for r in none)
