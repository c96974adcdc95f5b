"""Closed-form and recursive forecasters over series arrays.

A *path* is an array of ``(step, yhat, lo80, hi80, lo95, hi95)`` structs, one per forecast month.
Every forecaster maps the array of known values to a path inside the JVM, so a forecast adds no
shuffle and no Python to the plan that built the arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.functions import folds
from cashtide.operators.monthly import months_between
from cashtide.settings import Settings

Z80, Z95 = 1.28, 1.96  # Fixed values: interval multipliers


def _steps(horizon: int) -> Column:
    return F.sequence(F.lit(1), F.lit(horizon))


def _point_struct(step: Column, yhat: Column, spread: Column | None) -> Column:
    floor = folds.not_negative
    spread = F.lit(None).cast("double") if spread is None else spread
    return F.struct(
        step.cast("int").alias("step"),
        yhat.alias("yhat"),
        floor(yhat - F.lit(Z80) * spread).alias("lo80"),
        (yhat + F.lit(Z80) * spread).alias("hi80"),
        floor(yhat - F.lit(Z95) * spread).alias("lo95"),
        (yhat + F.lit(Z95) * spread).alias("hi95"),
    )


def flat_path(level: Column, spread: Column | None, horizon: int) -> Column:
    """The same level and spread in every month."""
    spread = F.lit(None).cast("double") if spread is None else spread
    return folds.let(
        F.struct(level.alias("level"), spread.alias("spread")),
        lambda fit: F.transform(
            _steps(horizon), lambda s: _point_struct(s, fit["level"], fit["spread"])
        ),
    )


def mean_path(ys: Column, horizon: int, settings: Settings) -> Column:
    """The mean of all known months."""
    return flat_path(folds.mean(ys), None, horizon)


def drift_path(ys: Column, horizon: int, settings: Settings) -> Column:
    """The last value plus the average monthly change."""
    n = F.size(ys)
    first, last = F.get(ys, F.lit(0)), F.get(ys, n - 1)
    slope = (last - first) / F.nullif(n - 1, F.lit(0))
    return folds.let(
        F.struct(last.alias("last"), slope.alias("slope")),
        lambda fit: F.transform(
            _steps(horizon), lambda s: _point_struct(s, fit["last"] + fit["slope"] * s, None)
        ),
    )


def seasonal_naive_path(ys: Column, horizon: int, settings: Settings) -> Column:
    """The same month one season ago; bounds from the seasonal changes, widening each season."""
    m, n = settings.season, F.size(ys)
    earlier = F.slice(ys, F.lit(1), F.greatest(n - m, F.lit(0)))
    later = F.slice(ys, F.lit(m + 1), F.greatest(n - m, F.lit(0)))
    changes = F.zip_with(later, earlier, lambda a, b: a - b)
    sigma = F.sqrt(folds.mean(F.transform(changes, lambda d: d * d)))

    def at(step: Column, spread: Column) -> Column:
        position = n - m + (step - 1) % m
        cycles = F.floor((step - 1) / m) + 1
        return _point_struct(step, F.get(ys, position), spread * F.sqrt(cycles))

    return folds.let(sigma, lambda spread: F.transform(_steps(horizon), lambda s: at(s, spread)))


def croston_path(ys: Column, horizon: int, settings: Settings) -> Column:
    """Flat demand rate; the spread is the deviation of the positive months."""
    rate = folds.croston_rate(folds.demand_points(ys), F.size(ys))
    return folds.let(
        rate, lambda r: flat_path(r, folds.level_spread(folds.positive(ys), r), horizon)
    )


def disrupted_months(settings: Settings) -> Column:
    """Number of leading months of a series that lie in the disrupted period."""
    return F.greatest(months_between(F.col("first_month"), F.lit(settings.disruption_end)), F.lit(0))


def level_values(ys: Column, settings: Settings, outlier_idx: Column | None) -> Column:
    """Months the level is learnt from.

    Positive months after the disruption that are no outliers; with fewer than three, outliers
    too; with fewer than two, every positive month.
    """
    start = disrupted_months(settings)
    calm = F.filter(ys, lambda y, i: (i >= start) & (y > 0))
    any_positive = folds.positive(ys)
    fallback = folds.let(calm, lambda c: F.when(F.size(c) >= 2, c).otherwise(any_positive))
    if outlier_idx is None:
        return fallback
    marked = F.coalesce(outlier_idx, F.array().cast("array<int>"))
    usual = F.filter(
        ys, lambda y, i: (i >= start) & (y > 0) & ~F.array_contains(marked, i.cast("int"))
    )
    return folds.let(usual, lambda u: F.when(F.size(u) >= 3, u).otherwise(fallback))


def level_values_backtest(ys: Column, settings: Settings) -> Column:
    """In backtests outliers are unknown: calm positive months, else positive ones, else all."""
    start = disrupted_months(settings)
    calm = F.filter(ys, lambda y, i: (i >= start) & (y > 0))
    any_positive = folds.positive(ys)
    return (
        F.when(F.size(calm) >= 2, calm)
        .when(F.size(any_positive) >= 1, any_positive)
        .otherwise(ys)
    )


def level_path_from(values: Column, horizon: int) -> Column:
    """Flat path from the months chosen for the level model."""

    def path(v: Column) -> Column:
        return folds.let(
            folds.decayed_level(v),
            lambda level: flat_path(level, folds.level_spread(v, level), horizon),
        )

    return folds.let(values, path)


def level_backtest_path(ys: Column, horizon: int, settings: Settings) -> Column:
    return level_path_from(level_values_backtest(ys, settings), horizon)


def level_path(ys: Column, horizon: int, settings: Settings) -> Column:
    """For arrays with an optional ``outlier_idx`` column use :func:`level_forecast`."""
    return level_path_from(level_values(ys, settings, None), horizon)


PathModel = Callable[[Column, int, Settings], Column]

FORECASTERS: dict[str, PathModel] = {
    "mean": mean_path,
    "drift": drift_path,
    "seasonal_naive": seasonal_naive_path,
    "croston": croston_path,
    "level": level_path,
}


def explode_path(paths: DataFrame, keys: tuple[str, ...], last_month: Column) -> DataFrame:
    """One row per forecast month; ``last_month`` is the last known month of the row."""
    return paths.select(*keys, last_month.alias("_last"), F.inline("path")).select(
        *keys,
        "step",
        F.add_months("_last", F.col("step")).alias("month"),
        "yhat",
        "lo80",
        "hi80",
        "lo95",
        "hi95",
    )


def last_known_month(ys: str = "ys") -> Column:
    return F.add_months("first_month", F.size(ys) - 1)


def forecast(arrays: DataFrame, model: str, horizon: int, settings: Settings) -> DataFrame:
    """Forecast every series with one model."""
    with_path = arrays.withColumn("path", FORECASTERS[model](F.col("ys"), horizon, settings))
    return explode_path(with_path, ("series_id",), last_known_month())


def level_forecast(arrays: DataFrame, horizon: int, settings: Settings) -> DataFrame:
    """Level forecast that leaves out the months in ``outlier_idx``."""
    values = level_values(F.col("ys"), settings, F.col("outlier_idx"))
    return explode_path(
        arrays.withColumn("path", level_path_from(values, horizon)),
        ("series_id",),
        last_known_month(),
    )


def with_outlier_positions(arrays: DataFrame, outliers: DataFrame) -> DataFrame:
    """Adds ``outlier_idx``: the positions of a series' flagged months.

    One array per series, never longer than its calendar.
    """
    positions = (
        outliers.groupBy("series_id").agg(F.collect_set("month").alias("_months"))
    )
    return (
        arrays.join(positions, "series_id", "left")
        .withColumn(
            "outlier_idx",
            F.transform("_months", lambda m: months_between(F.col("first_month"), m)),
        )
        .drop("_months")
    )


def croston_rates(demand: DataFrame, n_months: Column) -> DataFrame:
    """Croston rate and spread per series from its demand months only: ``(series_id, idx, y)``.

    Sparse series never get their empty months materialised. A series without demand has the rate 0.
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col("y") > 0, F.struct("idx", "y"))))
    points, rate = F.col("points"), F.col("rate")
    return (
        demand.groupBy("series_id")
        .agg(ordered.alias("points"))
        .withColumn("n_months", n_months)
        .withColumn("rate", folds.croston_rate(points, F.col("n_months")))
        .select(
            "series_id",
            F.size(points).alias("demand_months"),
            "rate",
            folds.level_spread(F.transform(points, lambda p: p["y"]), rate).alias("spread"),
        )
    )


def with_bounds(rates: DataFrame) -> DataFrame:
    """Adds the 80 and 95 % bounds of a flat rate."""
    rate, spread = F.col("rate"), F.col("spread")
    band = lambda z: (folds.not_negative(rate - F.lit(z) * spread), rate + F.lit(z) * spread)
    (lo80, hi80), (lo95, hi95) = band(Z80), band(Z95)
    return rates.select(
        "*", lo80.alias("lo80"), hi80.alias("hi80"), lo95.alias("lo95"), hi95.alias("hi95")
    )


def recent_floor(ys: Column, months: int = 18, share: float = 0.25) -> Column:
    """A share of the median positive value of the last months; 0 when there is none."""
    tail = F.slice(ys, F.greatest(F.size(ys) - months, F.lit(0)) + 1, F.lit(months))

    def middle(v: Column) -> Column:
        low = F.get(v, F.floor((F.size(v) - 1) / 2).cast("int"))
        high = F.get(v, F.floor(F.size(v) / 2).cast("int"))
        return F.coalesce((low + high) / 2, F.lit(0.0)) * share

    return folds.let(F.array_sort(folds.positive(tail)), middle)


def apply_floor(path: Column, ys: Column) -> Column:
    """Raises the points of a path to the floor and leaves the bounds as they are."""
    return folds.let(
        recent_floor(ys),
        lambda floor: F.transform(
            path, lambda p: p.withField("yhat", F.greatest(p["yhat"], floor))
        ),
    )


def combine_paths(a: Column, b: Column, c: Column, bounds: str) -> Column:
    """Ensemble of three members: the mean point and either ``median`` or ``mean`` bounds.

    Forecasts use clipped medians, so one explosive member cannot widen the interval; backtests
    use plain means.
    """
    trio = F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c"))
    clipped = folds.not_negative

    def merge(t: Column) -> Column:
        values = lambda name: F.array(t["a"][name], t["b"][name], t["c"][name])
        average = lambda name: (t["a"][name] + t["b"][name] + t["c"][name]) / 3
        middle = lambda name: F.get(F.array_sort(values(name)), F.lit(1))
        if bounds == "median":
            point, bound = clipped(average("yhat")), lambda name: clipped(middle(name))
        else:
            point, bound = average("yhat"), average
        return F.struct(
            t["a"]["step"].alias("step"),
            point.alias("yhat"),
            *[bound(name).alias(name) for name in ("lo80", "hi80", "lo95", "hi95")],
        )

    return F.transform(trio, merge)
