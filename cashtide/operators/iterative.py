"""Ensemble members, decomposition and structural breaks: numerics Spark has no expression for.

Spark partitions the work by series, origin and candidate; the batched functions see arrays only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.functions import batch_models, folds
from cashtide.functions.breaks import change_points
from cashtide.functions.theta import theta
from cashtide.operators import forecasters
from cashtide.operators.backtest import compare_paths, cv_windows
from cashtide.operators.forecasters import explode_path, last_known_month
from cashtide.operators.monthly import months_between
from cashtide.settings import Settings

ENSEMBLE = "ensemble"
# Normal quantiles of the 80 and 95 % intervals.
Q80, Q95 = 1.2815515655446004, 1.959963984540054

# Candidate orders (d, D, p, q).
ETS_KINDS = [(trend, season) for trend in ("N", "A", "Ad") for season in ("N", "A")]
ARIMA_ORDERS = [(d, sd, p, q) for d in (0, 1) for sd in (0, 1) for p in (0, 1, 2) for q in (0, 1, 2)]


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """Even out CPU-heavy rows over the cluster.

    The rows are small and few bytes would be merged into few tasks, hence the explicit number.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)


def fit_path(fit: Column) -> Column:
    """Path of a fitted member from its points and standard errors."""

    def at(value: Column, i: Column, errors: Column) -> Column:
        se = F.get(errors, i)
        return F.struct(
            (i + 1).cast("int").alias("step"),
            value.alias("yhat"),
            (value - F.lit(Q80) * se).alias("lo80"),
            (value + F.lit(Q80) * se).alias("hi80"),
            (value - F.lit(Q95) * se).alias("lo95"),
            (value + F.lit(Q95) * se).alias("hi95"),
        )

    return folds.let(
        fit, lambda f: F.transform(f["yhat"], lambda value, i: at(value, i, f["se"]))
    )


def theta_fit(rows: DataFrame, horizon: int, settings: Settings) -> DataFrame:
    """Adds ``theta``: the theta forecast of every row's ``ys``."""
    return rows.withColumn("theta", theta(F.col("ys"), horizon, settings.season))


def step_position(rows: DataFrame) -> Column:
    """Position of the structural break in ``ys``, from an optional ``break_month`` column."""
    if "break_month" not in rows.columns:
        return F.lit(None).cast("int")
    return months_between(F.col("first_month"), F.col("break_month"))


def _grid(names: tuple[str, ...], candidates: list[tuple]) -> Column:
    return F.array(
        *[
            F.struct(*[F.lit(v).alias(k) for k, v in zip(names, candidate, strict=True)])
            for candidate in candidates
        ]
    )


def arima_candidates(rows: DataFrame, horizon: int, settings: Settings) -> DataFrame:
    """One row per input row and candidate order, each fitted: column ``arima``."""
    fit = batch_models.arima_udf(horizon, settings.season)
    names = ("d", "sd", "p", "q")
    return (
        rows.withColumn("step_at", step_position(rows))
        .withColumn("_candidate", F.explode(_grid(names, ARIMA_ORDERS)))
        .withColumn("arima", fit("ys", "step_at", *[F.col(f"_candidate.{k}") for k in names]))
        .drop("step_at", "_candidate")
    )


def ets_candidates(rows: DataFrame, horizon: int, settings: Settings) -> DataFrame:
    """One row per input row and smoothing model, each fitted: column ``ets``."""
    fit = batch_models.ets_udf(horizon, settings.season)
    names = ("trend", "season")
    return (
        rows.withColumn("_candidate", F.explode(_grid(names, ETS_KINDS)))
        .withColumn("ets", fit("ys", *[F.col(f"_candidate.{k}") for k in names]))
        .drop("_candidate")
    )


def best_candidate(fitted: DataFrame, keys: tuple[str, ...], name: str) -> DataFrame:
    """The candidate with the lowest AICc per key; the other columns stay.

    Candidates of a row are exploded in place, so the minimum is mostly found before any shuffle
    and rows already partitioned by their keys do not move.
    """
    others = [c for c in fitted.columns if c not in (*keys, name)]
    usable = F.when(F.col(f"{name}.yhat").isNotNull(), F.col(f"{name}.aicc"))
    return fitted.groupBy(*keys).agg(
        F.min_by(name, usable).alias(name), *[F.first(c).alias(c) for c in others]
    )


def arima_fit(rows: DataFrame, keys: tuple[str, ...], horizon: int, settings: Settings) -> DataFrame:
    """Adds ``arima``, the AICc-best order; NULL for rows too short for every order."""
    return best_candidate(arima_candidates(rows, horizon, settings), keys, "arima")


def ets_fit(rows: DataFrame, keys: tuple[str, ...], horizon: int, settings: Settings) -> DataFrame:
    """Adds ``ets``, the AICc-best smoothing model; NULL for rows too short for every model."""
    return best_candidate(ets_candidates(rows, horizon, settings), keys, "ets")


def ensemble_paths(
    rows: DataFrame, keys: tuple[str, ...], horizon: int, settings: Settings, bounds: str
) -> DataFrame:
    """Adds ``path``, the combination of ARIMA, ETS and theta; ``bounds`` as in combine_paths.

    A row too short for any order or smoothing model takes theta in its place.
    """
    members = arima_fit(spread_out(rows, *keys), keys, horizon, settings)
    members = theta_fit(ets_fit(members, keys, horizon, settings), horizon, settings)
    combined = forecasters.combine_paths(
        *[
            fit_path(F.coalesce(F.col(member), F.col("theta")))
            for member in ("arima", "ets", "theta")
        ],
        bounds,
    )
    return members.withColumn("path", combined)


def ensemble_backtest(
    arrays: DataFrame, settings: Settings, first_breaks: DataFrame | None = None
) -> DataFrame:
    """Rolling-origin results of the ensemble, one task row per series and origin."""
    windows = cv_windows(arrays, settings)
    if first_breaks is not None:
        windows = windows.join(first_breaks, "series_id", "left")
    fitted = ensemble_paths(
        windows, ("series_id", "train_end"), settings.season, settings, bounds="mean"
    )
    return compare_paths(fitted, ENSEMBLE, F.col("path"))


def ensemble_forecast(
    arrays: DataFrame,
    horizon: int,
    settings: Settings,
    first_breaks: DataFrame | None = None,
) -> DataFrame:
    """Ensemble forecast of every series; the recent floor lifts the points only."""
    rows = arrays if first_breaks is None else arrays.join(first_breaks, "series_id", "left")
    fitted = ensemble_paths(rows, ("series_id",), horizon, settings, bounds="median")
    floored = fitted.withColumn("path", forecasters.apply_floor(F.col("path"), F.col("ys")))
    return explode_path(
        floored.withColumn("model", F.lit(ENSEMBLE)), ("series_id", "model"), last_known_month()
    )


def _fact_columns(arrays: DataFrame) -> list[Column]:
    """Months trained on, rounded share of months with revenue, and the break of a series, where it has one."""
    nonzero = F.size(F.filter("ys", lambda y: y > 0)) / F.size("ys") * 100
    break_month = F.col("break_month") if "break_month" in arrays.columns else F.lit(None).cast("date")
    return [
        F.size("ys").alias("n_train"),
        F.round(nonzero, 0).cast("int").alias("nonzero_pct"),
        break_month.alias("break_month"),
    ]


def series_facts(arrays: DataFrame, settings: Settings) -> DataFrame:
    """Facts that need no search over orders: months, non-zero share, break and the theta variant. No shuffle."""
    fitted = theta_fit(arrays, 1, settings)
    return fitted.select("series_id", *_fact_columns(arrays), F.col("theta.spec").alias("theta_method"))


def member_facts(arrays: DataFrame, settings: Settings) -> DataFrame:
    """Selected orders and AICc of every member, with months trained on and non-zero share."""
    rows = spread_out(arrays, "series_id")
    keys = ("series_id",)
    fitted = ets_fit(arima_fit(rows, keys, 1, settings), keys, 1, settings)
    fitted = theta_fit(fitted, 1, settings)
    return fitted.select(
        "series_id",
        *_fact_columns(arrays),
        F.col("arima.spec").alias("arima_order"),
        F.round("arima.aicc", 1).alias("arima_aicc"),
        F.col("ets.spec").alias("ets_method"),
        F.round("ets.aicc", 1).alias("ets_aicc"),
        F.col("theta.spec").alias("theta_method"),
    )


def stl(
    arrays: DataFrame,
    settings: Settings,
    seasonal_span: int = 7,
    trend_span: int | None = None,
    inner: int = 2,
    outer: int = 15,
) -> DataFrame:
    """Robust seasonal-trend decomposition by loess, one row per month.

    The default trend span is the smallest odd number above 1.5 m / (1 - 1.5 / seasonal span).
    """
    m = settings.season
    if trend_span is None:
        trend_span = int(1.5 * m / (1 - 1.5 / seasonal_span)) + 1
        trend_span += trend_span % 2 == 0
    fit = batch_models.stl_udf(m, seasonal_span, trend_span, inner, outer)
    parts = F.arrays_zip(
        F.col("ys").alias("y"),
        F.col("parts.trend").alias("trend"),
        F.col("parts.seasonal").alias("seasonal"),
        F.col("parts.remainder").alias("remainder"),
    )
    return (
        spread_out(arrays, "series_id")
        .withColumn("parts", fit("ys"))
        .select("series_id", "first_month", F.posexplode(parts).alias("idx", "p"))
        .select("series_id", F.add_months("first_month", F.col("idx")).alias("month"), "idx", "p.*")
    )


def structural_breaks(
    arrays: DataFrame, penalty: float = 15.0, min_size: int = 2, jump: int = 5
) -> DataFrame:
    """Break months by the segmentation that PELT finds. A break is reported as the last month of the segment before it."""
    return (
        spread_out(arrays, "series_id")
        .withColumn("ends", change_points(F.col("ys"), penalty, min_size, jump))
        .select("series_id", "first_month", F.explode("ends").alias("segment_end"))
        .select(
            "series_id",
            F.add_months("first_month", F.col("segment_end") - 1).alias("month"),
            "segment_end",
        )
    )
