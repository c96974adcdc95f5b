"""Iterative numerics: invariants, brute force, and published values."""

from __future__ import annotations

import itertools
import math
from datetime import date
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cashtide import Settings
from cashtide.functions import batch_models
from cashtide.functions.breaks import change_points
from cashtide.functions.normality import normal_quantile, normal_tail, shapiro_wilk_p
from cashtide.functions.tails import chi_square_tail
from cashtide.operators import iterative, scores
from cashtide.operators.robust import first_break

CALM = Settings(as_of=date(2030, 1, 1), series_start=date(2015, 1, 1), disruption_end=date(2015, 1, 1))
SEASON = [10, 12, 30, 28, 22, 18, 15, 11, 9, 14, 35, 50]


def seasonal_series(n=72, noise=0.5, seed=1):
    rng = np.random.default_rng(seed)
    return [100 + 0.5 * i + SEASON[i % 12] + rng.normal(0, noise) for i in range(n)]


def test_stl_parts_add_up_and_find_the_season(make_arrays):
    values = seasonal_series()
    values[30] += 400
    rows = iterative.stl(make_arrays({"a": values}), CALM).orderBy("idx").collect()
    assert len(rows) == 72
    for r in rows:
        assert r["trend"] + r["seasonal"] + r["remainder"] == pytest.approx(r["y"], abs=1e-8)
    # The spike stays in the remainder and leaves trend and season alone.
    assert max(range(72), key=lambda i: abs(rows[i]["remainder"])) == 30
    assert rows[30]["remainder"] > 380
    centred = np.array(SEASON) - np.mean(SEASON)
    assert np.allclose([r["seasonal"] for r in rows[24:36]], centred, atol=2.5)


def test_short_series_are_not_decomposed(make_arrays):
    assert iterative.stl(make_arrays({"a": [1.0] * 20}), CALM).count() == 0


def brute_force_breaks(values, penalty, min_size, jump):
    y = np.asarray(values, dtype=float)
    n = len(y)
    squared = (y[:, None] - y[None]) ** 2
    median = np.median(squared[np.triu_indices(n, 1)])
    gram = np.exp(-np.clip(squared / (median or 1.0), 1e-2, 1e2))
    np.fill_diagonal(gram, 1.0)
    cost = lambda a, b: (b - a) - gram[a:b, a:b].sum() / (b - a)
    grid = [k for k in range(0, n, jump) if k >= min_size]
    best = (math.inf, ())
    for size in range(len(grid) + 1):
        for cut in itertools.combinations(grid, size):
            edges = [0, *cut, n]
            if any(b - a < min_size for a, b in itertools.pairwise(edges)):
                continue
            total = sum(cost(a, b) + penalty for a, b in itertools.pairwise(edges))
            best = min(best, (total, cut))
    return list(best[1])


@pytest.mark.parametrize("penalty, min_size, jump", [(0.5, 2, 5), (1.0, 2, 5), (2.0, 7, 5), (3.0, 2, 4), (1.0, 3, 1)])
def test_change_points_equal_brute_force(spark, penalty, min_size, jump):
    rng = np.random.default_rng(int(penalty * 2))
    longest = 14 if jump == 1 else 50
    series = [np.concatenate([rng.normal(0, 1, 17), rng.normal(6, 1, 14), rng.normal(2, 1, 19)])[:longest]]
    series += [rng.normal(0, 1, n) for n in (2, 3, 5, 6, 11)] + [np.full(12, 3.0), np.round(rng.normal(0, 1, longest))]
    frame = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(series)], "i int, ys array<double>")
    found = frame.select("i", change_points(frame.ys, penalty, min_size, jump).alias("ends"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    for row in found.collect():
        assert row.ends == brute_force_breaks(series[row.i], penalty, min_size, jump), (row.i, series[row.i])


def test_no_values_have_no_change_points(spark):
    frame = spark.createDataFrame([(1, []), (2, None), (3, [1.0])], "i int, ys array<double>")
    rows = frame.select("i", change_points(frame.ys, 1.0, 2, 5).alias("ends")).collect()
    assert {r.i: r.ends for r in rows} == {1: None, 2: None, 3: []}


def test_a_step_is_reported_as_the_last_month_before_it(make_arrays):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(10, 1, 40), rng.normal(200, 1, 40)])
    breaks = iterative.structural_breaks(make_arrays({"a": values, "flat": rng.normal(5, 1, 80)}))
    rows = breaks.collect()
    assert [(r["series_id"], r["segment_end"], r["month"]) for r in rows] == [("a", 40, date(2018, 4, 1))]
    assert first_break(breaks).first()["break_month"] == date(2018, 4, 1)


def test_ensemble_beats_the_benchmark_on_a_seasonal_series(make_arrays):
    arrays = make_arrays({"a": seasonal_series(n=72, noise=3.0)})
    row = scores.score(iterative.ensemble_backtest(arrays, CALM)).first()
    assert row["mase"] < 1.0


def test_ensemble_forecast_contract(make_arrays):
    arrays = make_arrays(
        {"season": seasonal_series(), "short": [5.0, 6.0, 7.0, 5.0, 6.0] * 5, "sparse": [0, 0, 7.0, 0, 0] * 8,
         "empty": [0.0] * 30, "tiny": [3.0, 4.0]}
    )
    rows = iterative.ensemble_forecast(arrays, 24, CALM).collect()
    assert len(rows) == 5 * 24
    for r in rows:
        values = [r[c] for c in ("yhat", "lo80", "hi80", "lo95", "hi95")]
        assert all(math.isfinite(v) and v >= 0 for v in values)
        assert r["lo80"] <= r["hi80"] and r["lo95"] <= r["hi95"]
        assert r["lo95"] <= r["lo80"] and r["hi80"] <= r["hi95"]


def best_ets(y, h):
    fits = [batch_models.fit_ets(y, *kind, h, 12)[0] for kind in iterative.ETS_KINDS]
    return min(fits, key=lambda fit: fit[2])


def test_members_recover_simple_processes():
    rng = np.random.default_rng(2)
    noise = rng.normal(0, 1, 120)
    y = np.zeros(120)
    for t in range(1, 120):
        y[t] = 0.8 * y[t - 1] + noise[t]
    y = y[None] + 50
    fits = [
        batch_models.fit_arima(y, np.zeros_like(y), order, 12, 12)[0]
        for order in iterative.ARIMA_ORDERS
    ]
    best = min(fits, key=lambda f: f[2])
    white = batch_models.fit_arima(y, np.zeros_like(y), (0, 0, 0, 0), 12, 12)[0]
    assert best[2] < white[2] - 20
    trend = (np.arange(60) * 2.0 + 5)[None]
    point = best_ets(trend, 3)[0]
    assert np.allclose(point, [125, 127, 129], atol=0.5)
    season = np.tile(SEASON, 6).astype(float)[None]
    assert np.allclose(best_ets(season, 12)[0], SEASON, atol=1.0)


def slow_theta(y, h, m=12):
    """Theta in plain numpy."""
    y, n = np.asarray(y, dtype=float), len(y)
    ratio, seasonal = bool((y > 0).all()), False
    index = np.full(m, 1.0 if ratio else 0.0)
    d = y - y.mean()
    if n >= 2 * m + 1 and (d * d).sum() > 0:
        r = np.array([(d[k:] * d[: n - k]).sum() / (d * d).sum() for k in range(1, m + 1)])
        seasonal = abs(r[-1]) > 1.645 * np.sqrt((1 + 2 * (r[:-1] ** 2).sum()) / n)
    if seasonal:
        kernel = np.r_[0.5, np.ones(m - 1), 0.5] / m
        trend, inner = np.convolve(y, kernel, "valid"), y[m // 2 : n - m // 2]
        effect = inner / trend if ratio else inner - trend
        slots = (np.arange(len(inner)) + m // 2) % m
        index = np.array([effect[slots == s].mean() for s in range(m)])
        index = index / index.mean() if ratio else index - index.mean()
    season = index[np.arange(n) % m]
    x = y / season if ratio else y - season

    def run(alpha):
        level, sse = x[0], 0.0
        for v in x[1:]:
            sse, level = sse + (v - level) ** 2, level + alpha * (v - level)
        return sse, alpha, level

    _, alpha, _ = min(run(0.02 + 0.04 * i) for i in range(25))
    _, alpha, level = min(run(min(max(alpha + 0.005 * i, 0.01), 0.99)) for i in range(-4, 5))
    time = np.arange(n) - (n - 1) / 2
    slope = (x * time).sum() / (time**2).sum()
    steps = np.arange(1, h + 1)
    point = level + 0.5 * slope * (steps - 1 + (1 - (1 - alpha) ** n) / alpha)
    ahead = index[(n + steps - 1) % m]
    return point * ahead if ratio else point + ahead


def test_theta_equals_a_plain_loop(make_arrays):
    rng = np.random.default_rng(6)
    series = {
        "season": seasonal_series(), "noise": rng.normal(50, 9, 40), "zeros": rng.uniform(0, 9, 60).round() * 2.0,
        "signed": np.array(seasonal_series(seed=3)) - 130, "short": [3.0, 5.0, 4.0, 8.0],
    }
    rows = iterative.theta_fit(make_arrays(series), 14, CALM).select("series_id", "theta.*").collect()
    for r in rows:
        assert np.allclose(r["yhat"], slow_theta(series[r["series_id"]], 14)), r["series_id"]
        assert (r["spec"] == "Theta(seasonal)") == (r["series_id"] in ("season", "signed"))
        assert all(b >= a > 0 for a, b in zip(r["se"][:12], r["se"][12:]))


def test_theta_recovers_a_season(make_arrays):
    season = make_arrays({"a": SEASON * 6})
    fit = iterative.theta_fit(season, 12, CALM).first()["theta"]
    assert np.allclose(fit["yhat"], SEASON, atol=1.0)


def test_rows_of_a_batch_do_not_influence_each_other():
    a, b = np.array([seasonal_series(seed=1)]), np.array([seasonal_series(seed=2)])
    both = np.vstack([a, b])
    for kind in iterative.ETS_KINDS:
        together, alone = batch_models.fit_ets(both, *kind, 6, 12), batch_models.fit_ets(b, *kind, 6, 12)
        assert np.allclose(together[1][0], alone[0][0]) and np.isclose(together[1][2], alone[0][2])


def test_step_regressor_follows_a_level_shift():
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(10, 1, 50), rng.normal(40, 1, 10)])[None]
    step = np.concatenate([np.zeros(50), np.ones(10)])[None]
    with_step = batch_models.fit_arima(y, step, (0, 0, 0, 0), 3, 12)[0]
    without = batch_models.fit_arima(y, np.zeros_like(y), (0, 0, 0, 0), 3, 12)[0]
    assert abs(with_step[0][0] - 40) < 1.5 and abs(without[0][0] - 40) > 5
    assert with_step[2] < without[2]


def test_arima_forecast_uses_the_break_month(make_arrays):
    rng = np.random.default_rng(4)
    y = np.concatenate([rng.normal(10, 1, 50), rng.normal(40, 1, 20)])
    arrays = make_arrays({"a": y})
    breaks = arrays.sparkSession.createDataFrame([("a", date(2019, 3, 1))], "series_id string, break_month date")
    rows = iterative.ensemble_forecast(arrays, 3, CALM, breaks).collect()
    assert all(abs(r["yhat"] - 40) < 6 for r in rows)
    facts = iterative.member_facts(arrays.join(breaks, "series_id"), CALM).first()
    assert facts["break_month"] == date(2019, 3, 1) and facts["nonzero_pct"] == 100


def shapiro_of(spark, samples):
    frame = spark.createDataFrame([(i, None if x is None else [float(v) for v in x]) for i, x in enumerate(samples)], "i int, x array<double>")
    found = frame.select("i", shapiro_wilk_p(frame.x).alias("p"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    return [r.p for r in found.orderBy("i").collect()]


def test_shapiro_wilk_published_example(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rng = np.random.default_rng(0)
    samples = [weights, rng.normal(0, 1, 200), rng.exponential(1, 200), [1, 2], [2, 2, 2], None, [], [1, 2, 3], [0, 0, 1]]
    p = shapiro_of(spark, samples)
    assert p[0] == pytest.approx(0.006704, abs=2e-4) and p[1] > 0.05 and p[2] < 1e-6
    assert p[3:7] == [None] * 4
    # Three values at equal steps are as normal as three can be; two equal ones as little.
    assert p[7] == pytest.approx(1.0) and p[8] == pytest.approx(0.0, abs=1e-9)


def test_normal_quantile_and_tail(spark):
    points = [1e-12, 1e-5, 0.0249, 0.074, 0.075, 0.2, 0.5, 0.7, 0.925, 0.99999]
    frame = spark.createDataFrame([(p,) for p in points], "p double")
    for row in frame.select("p", normal_quantile(frame.p).alias("z")).withColumn("back", 1 - normal_tail(F.col("z"))).collect():
        assert row.z == pytest.approx(NormalDist().inv_cdf(row.p), rel=1e-12, abs=1e-14)
        assert row.back == pytest.approx(row.p, rel=1e-3, abs=1e-14)


def chi_square_sf(q, df):
    """The closed form: a finite Poisson sum, plus an error function when ``df`` is odd."""
    if q <= 0:
        return 1.0
    half, odd = q / 2.0, df % 2
    tail = math.erfc(math.sqrt(half)) if odd else 0.0
    for j in range(df // 2):
        power = j + 0.5 * odd
        tail += math.exp(power * math.log(half) - half - math.lgamma(power + 1.0))
    return min(1.0, tail)


def test_chi_square_tail_as_columns(spark):
    cases = [(q, df) for df in (1, 2, 3, 4, 7, 12, 13, 60, 201, 1000) for q in (1e-9, 0.3, 1.0, df * 0.5, df - 1.0, df + 1.99, df + 2.01, df * 1.5, df * 4.0, 3000.0)]
    rows = spark.createDataFrame([*cases, (None, 3), (float("nan"), 3), (-1.0, 2)], "q double, df int")
    plan = rows.select("q", "df", chi_square_tail(rows.q, rows.df).alias("p"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    for row in plan.collect():
        if row.q is None or math.isnan(row.q):
            assert row.p is None
        else:
            assert row.p == pytest.approx(chi_square_sf(row.q, row.df), rel=1e-9, abs=1e-12), row


@pytest.mark.parametrize(
    "q, df, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (0.0, 4, 1.0)]
)
def test_chi_square_tail(q, df, p):
    assert chi_square_sf(q, df) == pytest.approx(p, abs=1e-6)


def test_autocorrelations_against_numpy(make_arrays):
    rng = np.random.default_rng(9)
    values = rng.normal(0, 1, 60).cumsum()
    arrays = make_arrays({"a": values, "flat": [2.5] * 30})
    d = values - values.mean()
    rho = [float((d[k:] * d[: 60 - k]).sum() / (d * d).sum()) for k in range(25)]
    got = {(r["series_id"], r["lag"]): r["acf"] for r in scores.acf(arrays).collect()}
    assert np.allclose([got["a", k] for k in range(25)], rho)
    assert got["flat", 1] is None
    partial = {r["lag"]: r["pacf"] for r in scores.pacf(arrays).filter("series_id = 'a'").collect()}
    for k in (1, 2, 5, 24):
        toeplitz = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        assert partial[k] == pytest.approx(np.linalg.solve(toeplitz, rho[1 : k + 1])[-1])


def test_ljung_box_lags_and_minimum(spark):
    rng = np.random.default_rng(1)
    residuals = [float(v) for v in rng.normal(0, 1, 24)]
    frame = spark.createDataFrame(
        [("a", "m", residuals), ("few", "m", residuals[:9])],
        "series_id string, model string, residuals array<double>",
    )
    q = scores.ljung_box(frame)
    rows = sorted(q.collect(), key=lambda r: r["lag"])
    assert [r["lag"] for r in rows] == [1, 2, 3, 4]
    d = np.array(residuals) - np.mean(residuals)
    r = [float((d[k:] * d[: 24 - k]).sum() / (d * d).sum()) for k in range(5)]
    expected = [24 * 26 * sum(r[j] ** 2 / (24 - j) for j in range(1, k + 1)) for k in range(1, 5)]
    assert np.allclose([x["q"] for x in rows], expected)
    p = scores.ljung_box_p(q).first()["ljung_box_p"]
    assert p == pytest.approx(min(chi_square_sf(v, k) for k, v in enumerate(expected, 1)))
    assert scores.normality(frame.withColumn("residuals", F.slice("residuals", 1, 2))).first()["shapiro_p"] is None
