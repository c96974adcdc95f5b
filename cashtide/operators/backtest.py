"""Rolling-origin backtests: one row per series and origin, all evaluated in one job.

Origins are exploded from the series array, so the windows share the series' partition: scoring
groups by series and model and needs no further shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.operators import forecasters
from cashtide.settings import Settings

# Croston and the seasonal naive benchmark are scored on points only.
WITHOUT_BOUNDS = ("croston", "seasonal_naive", "mean", "drift")

BACKTEST_PATHS = {**forecasters.FORECASTERS, "level": forecasters.level_backtest_path}


def origin_ends(n: Column, settings: Settings) -> Column:
    """Training lengths, oldest first: the last test ends with the series, each starts ``cv_step``
    months after the one before, and short trainings are left out."""
    ends = F.transform(
        F.sequence(F.lit(settings.cv_windows - 1), F.lit(0), F.lit(-1)),
        lambda i: n - settings.season - i * settings.cv_step,
    )
    return F.filter(ends, lambda end: end >= settings.min_train)


def mase_scale(ys: Column, settings: Settings) -> Column:
    """Mean absolute seasonal change of the whole series; NULL when undefined or zero."""
    m, n = settings.season, F.size(ys)
    count = F.greatest(n - m, F.lit(0))
    changes = F.zip_with(
        F.slice(ys, F.lit(m + 1), count), F.slice(ys, F.lit(1), count), lambda a, b: F.abs(a - b)
    )
    total = F.aggregate(changes, F.lit(0.0), lambda acc, v: acc + v)
    return F.nullif(total / F.nullif(count, F.lit(0)), F.lit(0.0))


def cv_windows(arrays: DataFrame, settings: Settings) -> DataFrame:
    """One row per series and origin with its training and test values.

    The MASE scale comes from the full series, not from the training part.
    """
    m = settings.season
    return (
        arrays.withColumn("scale", mase_scale(F.col("ys"), settings))
        .withColumn("train_end", F.explode(origin_ends(F.size("ys"), settings)))
        .select(
            "series_id",
            "first_month",
            "scale",
            "train_end",
            (F.col("train_end") + m).alias("test_end"),
            F.slice("ys", F.lit(1), F.col("train_end")).alias("ys"),
            F.slice("ys", F.col("train_end") + 1, F.lit(m)).alias("actual"),
        )
    )


def compare_paths(windows: DataFrame, model: str | Column, path: Column) -> DataFrame:
    """One row per series, origin and test month with the actual and the forecast."""
    model = F.lit(model) if isinstance(model, str) else model
    pairs = F.zip_with("actual", path, lambda y, p: F.struct(y.alias("y"), p.alias("p")))
    return (
        windows.select(
            "series_id", "first_month", "scale", model.alias("model"), "train_end",
            F.inline(pairs),
        )
        .select(
            "series_id",
            "model",
            "train_end",
            F.col("p.step").alias("step"),
            F.add_months("first_month", F.col("train_end") + F.col("p.step") - 1).alias("month"),
            "scale",
            "y",
            F.col("p.yhat").alias("yhat"),
            F.col("p.lo80").alias("lo80"),
            F.col("p.hi80").alias("hi80"),
        )
    )


def backtest(arrays: DataFrame, models: Sequence[str], settings: Settings) -> DataFrame:
    """Backtest the JVM-side models together: one pass over the windows, not one per model."""
    windows = cv_windows(arrays, settings)
    runs = []
    for model in models:
        path = BACKTEST_PATHS[model](F.col("ys"), settings.season, settings)
        if model in WITHOUT_BOUNDS:
            absent = F.lit(None).cast("double")
            path = F.transform(
                path, lambda p: p.withField("lo80", absent).withField("hi80", absent)
            )
        kept = F.transform(
            path,
            lambda p: F.struct(
                p["step"].alias("step"),
                p["yhat"].alias("yhat"),
                p["lo80"].alias("lo80"),
                p["hi80"].alias("hi80"),
            ),
        )
        runs.append(F.struct(F.lit(model).alias("name"), kept.alias("path")))
    return compare_paths(
        windows.withColumn("run", F.explode(F.array(*runs))), F.col("run.name"), F.col("run.path")
    )


def window_table(arrays: DataFrame, settings: Settings) -> DataFrame:
    """The windows as a report: bounds, lengths and revenue of both parts."""
    total = lambda values: F.round(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v), 2)
    return cv_windows(arrays, settings).select(
        "series_id",
        "train_end",
        "test_end",
        F.size("ys").alias("train_months"),
        F.size("actual").alias("test_months"),
        total(F.col("ys")).alias("train_total"),
        total(F.col("actual")).alias("test_total"),
    )
