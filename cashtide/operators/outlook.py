"""Forecast assembly: dispatch by selected model, bottom-up totals, scenarios, serving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.functions.folds import let
from cashtide.operators import contracts, forecasters
from cashtide.operators.forecasters import explode_path, last_known_month
from cashtide.settings import Settings

BOUNDS = ("lo80", "hi80", "lo95", "hi95")
MAX_HORIZON = 24


def forecast_by_model(
    arrays: DataFrame,
    selected: DataFrame,
    horizon: int,
    settings: Settings,
    models: Sequence[str] = tuple(forecasters.FORECASTERS),
) -> DataFrame:
    """Forecast each series with the model chosen for it, in one pass.

    A CASE over the paths of ``models`` evaluates only the chosen one. Series without a choice
    among them are left out. ``arrays`` may carry ``outlier_idx``, which the level model leaves
    out.
    """
    ys = F.col("ys")
    marked = F.col("outlier_idx") if "outlier_idx" in arrays.columns else None
    chosen = F.lit(None)
    for name in models:
        if name == "level":
            values = forecasters.level_values(ys, settings, marked)
            path = forecasters.level_path_from(values, horizon)
        else:
            path = forecasters.FORECASTERS[name](ys, horizon, settings)
        chosen = F.when(F.col("model") == name, path).otherwise(chosen)
    choices = selected.select("series_id", "model").filter(F.col("model").isin(*models))
    routed = arrays.join(choices, "series_id")
    return explode_path(
        routed.withColumn("path", chosen), ("series_id", "model"), last_known_month()
    )


def _complete_sums() -> dict[str, Column]:
    """Sums of point and bounds; NULL where a series lacks the value, never a partial sum."""
    return {
        name: F.when(F.count(name) == F.count("*"), F.round(F.sum(name), 2))
        for name in ("yhat", *BOUNDS)
    }


def total_forecast(forecast: DataFrame) -> DataFrame:
    """Bottom-up total: points and bounds of all series added per month.

    Partial aggregation leaves one row per month and task, however many series there are.
    """
    return (
        forecast.groupBy("step", "month")
        .agg(*[column.alias(name) for name, column in _complete_sums().items()])
        .select(
            "step",
            "month",
            F.col("yhat").alias("total"),
            *BOUNDS,
            F.col("lo80").alias("bear"),
            F.col("yhat").alias("base"),
            F.col("hi80").alias("bull"),
        )
    )


def forecast_table(forecast: DataFrame, streams: Sequence[str]) -> DataFrame:
    """The published table: one column per stream next to the total and its scenarios.

    One grouping gives streams and totals, so the forecast is not joined to itself.
    """
    per_stream = [
        F.round(F.sum(F.when(F.col("series_id") == s, F.col("yhat"))), 2).alias(s)
        for s in streams
    ]
    return (
        forecast.groupBy("month")
        .agg(*per_stream, *[column.alias(name) for name, column in _complete_sums().items()])
        .select(
            "month",
            *streams,
            F.col("yhat").alias("total_base"),
            *[F.col(name).alias(f"total_{name}") for name in BOUNDS],
            F.col("lo80").alias("bear"),
            F.col("yhat").alias("base"),
            F.col("hi80").alias("bull"),
        )
    )


def expand_requests(requests: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per request and forecast month asked for; a request for less than one month is one row without a step."""
    return requests.select(
        "request_id",
        "horizon",
        "level",
        *keep,
        F.explode_outer(F.when(F.col("horizon") >= 1, F.sequence(F.lit(1), F.col("horizon")))).alias("step"),
    )


def score_requests(
    requests: DataFrame, total: DataFrame, keep: Sequence[str] = (), max_horizon: int = MAX_HORIZON
) -> DataFrame:
    """Answer requests from the stored total forecast, with the bounds of the asked level.

    Months the forecast does not reach are rows without values, which the forecast contract does not accept.

    Requests become one row per month and then meet the forecast by equality on the step. The
    forecast has one row per step and at most ``max_horizon`` steps, which is what makes the
    broadcast safe; the filter states that bound.
    """
    stored = total.filter(F.col("step").between(1, max_horizon)).select(
        "step", "month", F.col("total").alias("yhat"), *BOUNDS
    )
    asked = F.col("level")
    return (
        expand_requests(requests, keep)
        .join(F.broadcast(stored), "step", "left")
        .select(
            "request_id",
            "horizon",
            "level",
            *keep,
            "step",
            "month",
            "yhat",
            F.when(asked == 95, F.col("lo95")).otherwise(F.col("lo80")).alias("lo"),
            F.when(asked == 95, F.col("hi95")).otherwise(F.col("hi80")).alias("hi"),
        )
    )


def serve(
    requests: DataFrame, total: DataFrame, keep: Sequence[str] = (), max_horizon: int = MAX_HORIZON
) -> tuple[DataFrame, DataFrame]:
    """(answers, refused requests with their reasons), as a service would: an answer is right or it fails.

    ``requests(request_id, horizon, level)`` may have the columns of ``keep`` besides; any other field is an error. Requests
    that break the request rules are refused, a missing level is 80. Each other request is answered with all its months,
    and the query fails, naming the request, where the forecast is short, has a month twice, a value that is
    missing, infinite or negative, or bounds the wrong way round. The stored forecast is one small array that every
    request takes its months from, so requests are not moved.
    """
    contracts.require_known_columns(requests, (*contracts.REQUEST_COLUMNS, *keep))
    judged = contracts.with_reasons(contracts.with_default_level(requests), contracts.request_rules(max_horizon))
    refused = judged.where(F.size("reasons") > 0)
    asked = judged.where(F.size("reasons") == 0).select("request_id", F.col("horizon").cast("int").alias("horizon"), "level", *keep)
    stored = total.where(F.col("step").between(1, max_horizon)).agg(
        F.array_sort(F.collect_list(F.struct("step", "month", F.col("total").alias("yhat"), *BOUNDS))).alias("months")
    )

    def answer(months: Column) -> Column:
        wide = F.col("level") == 95
        return F.transform(
            F.filter(months, lambda m: m["step"] <= F.col("horizon")),
            lambda m: F.struct(
                m["step"].alias("step"),
                m["month"].alias("month"),
                m["yhat"].alias("yhat"),
                F.when(wide, m["lo95"]).otherwise(m["lo80"]).alias("lo"),
                F.when(wide, m["hi95"]).otherwise(m["hi80"]).alias("hi"),
            ),
        )

    def checked(path: Column) -> Column:
        every = lambda holds: F.coalesce(F.forall(path, holds), F.lit(False))
        finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
        steps = F.transform(path, lambda m: m["step"].cast("int"))
        faults = F.concat_ws(
            ", ",
            F.when(steps != F.sequence(F.lit(1), F.col("horizon")), "months missing or repeated"),
            F.when(~every(lambda m: finite(m["yhat"]) & finite(m["lo"]) & finite(m["hi"])), "values missing or infinite"),
            F.when(F.exists(path, lambda m: (m["yhat"] < 0) | (m["lo"] < 0) | (m["hi"] < 0)), "values negative"),
            F.when(F.exists(path, lambda m: m["lo"] > m["hi"]), "bounds crossed"),
        )
        told = F.concat(F.lit("forecast contract, request "), F.col("request_id").cast("string"), F.lit(": "), faults)
        return F.when(faults == "", path).otherwise(F.raise_error(told))

    answers = asked.withColumn("_months", stored.scalar())
    # Bound once: the checks read the answer many times.
    answers = answers.withColumn("_path", let(answer(F.col("_months")), checked))
    return answers.select("request_id", "horizon", "level", *keep, F.inline("_path")), refused
