"""Reporting tables over history and forecast.

Most work on a *timeline* ``(series_id, month, kind, y, bear, bull)`` with ``kind`` 'actual' or
'forecast', one row per series and month. All of them group or window by ``series_id``, so the
same functions serve one total and any number of series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOTAL = "total"


def combine_streams(
    long: DataFrame, groups: Mapping[str, str], values: Sequence[str] = ("y",)
) -> DataFrame:
    """Adds streams up into display groups; streams not named keep their own name."""
    shown = F.col("series_id")
    for stream, group in groups.items():
        shown = F.when(F.col("series_id") == stream, group).otherwise(shown)
    return (
        long.withColumn("series_id", shown)
        .groupBy("series_id", "month")
        .agg(*[F.round(F.sum(v), 2).alias(v) for v in values])
    )


def total_series(long: DataFrame, values: Sequence[str] = ("y",)) -> DataFrame:
    """All series added up per month, as one series named 'total'."""
    sums = long.groupBy("month").agg(*[F.round(F.sum(v), 2).alias(v) for v in values])
    return sums.select(F.lit(TOTAL).alias("series_id"), "month", *values)


def timeline(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """History and forecast rows of the same series, one under the other."""
    absent = F.lit(None).cast("double")
    actual = history.select(
        "series_id",
        "month",
        F.lit("actual").alias("kind"),
        "y",
        absent.alias("bear"),
        absent.alias("bull"),
    )
    planned = forecast.select(
        "series_id",
        "month",
        F.lit("forecast").alias("kind"),
        F.col("yhat").alias("y"),
        F.col("lo80").alias("bear"),
        F.col("hi80").alias("bull"),
    )
    return actual.unionByName(planned)


def history_bridge(line: DataFrame) -> DataFrame:
    """Forecast rows preceded by the last actual of the series, so that the two lines meet."""
    whole = Window.partitionBy("series_id")
    actual_month = F.when(F.col("kind") == "actual", F.col("month"))
    return (
        line.withColumn("_last", F.max(actual_month).over(whole))
        .filter((F.col("kind") == "forecast") | (F.col("month") == F.col("_last")))
        .select("series_id", "month", "kind", "y")
    )


def _sum_where(condition: Column, value: str = "y") -> Column:
    return F.sum(F.when(condition, F.col(value)))


def _pct(new: Column, old: Column) -> Column:
    """Change in percent; NULL when there is nothing to compare with."""
    return (new - old) / F.nullif(old, F.lit(0.0)) * 100


def _actual() -> Column:
    return F.col("kind") == "actual"


def _with_last_actual(line: DataFrame) -> DataFrame:
    last = F.max(F.when(_actual(), F.col("month"))).over(Window.partitionBy("series_id"))
    return line.withColumn("last_actual", last)


def ytd_tracker(line: DataFrame) -> DataFrame:
    """Year to date, the same months last year, and the projected full year."""
    year, last_year = F.year("month"), F.year("last_actual")
    this_year = _actual() & (year == last_year)
    # The first n months of last year, n being the months known this year.
    same_months = _actual() & (year == last_year - 1) & (F.month("month") <= F.month("last_actual"))
    ahead = (F.col("kind") == "forecast") & (year == last_year)
    zero = F.lit(0.0)
    return (
        _with_last_actual(line)
        .groupBy("series_id")
        .agg(
            F.max(last_year).alias("year"),
            F.count_if(this_year).alias("ytd_months"),
            F.round(F.coalesce(_sum_where(this_year), zero), 2).alias("ytd_actual"),
            F.round(F.coalesce(_sum_where(same_months), zero), 2).alias("prior_ytd"),
            F.round(F.coalesce(_sum_where(ahead), zero), 2).alias("remaining"),
        )
        .withColumn(
            "yoy_pct", F.coalesce(_pct(F.col("ytd_actual"), F.col("prior_ytd")), zero)
        )
        .withColumn("full_year", F.round(F.col("ytd_actual") + F.col("remaining"), 2))
    )


def vs_prior_year(line: DataFrame) -> DataFrame:
    """Forecast horizon against the last full calendar year, and the Bear to Bull spread."""
    prior = _actual() & (F.year("month") == F.year("last_actual") - 1)
    planned = F.col("kind") == "forecast"
    return (
        _with_last_actual(line)
        .groupBy("series_id")
        .agg(
            F.round(F.coalesce(_sum_where(prior), F.lit(0.0)), 2).alias("prior_year"),
            F.round(_sum_where(planned), 2).alias("base"),
            F.round(_sum_where(planned, "bear"), 2).alias("bear"),
            F.round(_sum_where(planned, "bull"), 2).alias("bull"),
        )
        .withColumn("spread", F.round(F.col("bull") - F.col("bear"), 2))
        .withColumn(
            "pct_vs_prior",
            F.coalesce(F.abs(_pct(F.col("base"), F.col("prior_year"))), F.lit(0.0)),
        )
    )


def _ranked(line: DataFrame) -> DataFrame:
    """``age`` counts actuals back from the newest, forecasts forward from the first; from 1."""
    back = Window.partitionBy("series_id", "kind").orderBy(F.desc("month"))
    count = F.count("*").over(Window.partitionBy("series_id", "kind"))
    from_end = F.row_number().over(back)
    return line.withColumn(
        "age", F.when(_actual(), from_end).otherwise(count - from_end + 1)
    )


def stream_kpi(line: DataFrame) -> DataFrame:
    """Forecast sum and monthly mean, and the mean of the last twelve actuals."""
    planned = F.col("kind") == "forecast"
    recent = _actual() & (F.col("age") <= 12)
    return (
        _ranked(line)
        .groupBy("series_id")
        .agg(
            F.round(_sum_where(planned), 2).alias("forecast_sum"),
            F.avg(F.when(planned, F.col("y"))).alias("forecast_mean"),
            F.avg(F.when(recent, F.col("y"))).alias("last12_mean"),
        )
        .withColumn("pct_vs_last12", _pct(F.col("forecast_mean"), F.col("last12_mean")))
    )


def stream_health(line: DataFrame, band_pct: float = 5.0) -> DataFrame:
    """Last six against the six before, next twelve against the last twelve, and a verdict."""
    age = F.col("age")
    recent6, prior6 = _actual() & (age <= 6), _actual() & age.between(7, 12)
    last12 = _actual() & (age <= 12)
    next12 = (F.col("kind") == "forecast") & (age <= 12)
    zero = F.lit(0.0)
    outlook = F.col("outlook_pct")
    return (
        _ranked(line)
        .groupBy("series_id")
        .agg(
            F.avg(F.when(recent6, F.col("y"))).alias("recent6_mean"),
            F.avg(F.when(prior6, F.col("y"))).alias("prior6_mean"),
            F.round(_sum_where(last12), 2).alias("last12"),
            F.round(_sum_where(next12), 2).alias("next12"),
        )
        .withColumn(
            "momentum_pct", F.coalesce(_pct(F.col("recent6_mean"), F.col("prior6_mean")), zero)
        )
        .withColumn("outlook_pct", F.coalesce(_pct(F.col("next12"), F.col("last12")), zero))
        .withColumn(
            "status",
            F.when(outlook > band_pct, "Growing")
            .when(outlook < -band_pct, "Declining")
            .otherwise("Stable"),
        )
    )


def mom_growth(history: DataFrame, months: int = 6) -> DataFrame:
    """Mean month-over-month change in percent within the last months; 0 when undefined."""
    by_month = Window.partitionBy("series_id").orderBy("month")
    newest = Window.partitionBy("series_id").orderBy(F.desc("month"))
    change = F.col("y") / F.nullif(F.col("_before"), F.lit(0.0)) - 1
    return (
        history.withColumn("_age", F.row_number().over(newest))
        .withColumn("_before", F.lag("y").over(by_month))
        # The oldest month kept has no change of its own within the tail.
        .withColumn("_change", F.when(F.col("_age") < months, change))
        .filter(F.col("_age") <= months)
        .groupBy("series_id")
        .agg(F.coalesce(F.avg("_change") * 100, F.lit(0.0)).alias("mom_growth_pct"))
    )


def latest_month(history: DataFrame, streams: list[str]) -> DataFrame:
    """Newest month: total, the same month last year, and every stream's share in percent."""
    line = Window.partitionBy("series_id").orderBy("month")
    latest = lambda column: F.max_by(column, F.col("month"))
    per_series = (
        history.withColumn("_year_ago", F.lag("y", 12).over(line))
        .groupBy("series_id")
        .agg(
            F.max("month").alias("month"),
            latest(F.col("y")).alias("y"),
            latest(F.col("_year_ago")).alias("year_ago"),
        )
    )
    split = [
        F.round(F.sum(F.when(F.col("series_id") == s, F.col("y"))), 2).alias(s) for s in streams
    ]
    return (
        per_series.groupBy("month")
        .agg(
            F.round(F.sum("y"), 2).alias("total"),
            F.round(F.sum("year_ago"), 2).alias("year_ago"),
            *split,
        )
        .select(
            "*",
            _pct(F.col("total"), F.col("year_ago")).alias("yoy_pct"),
            *[
                (F.col(s) / F.nullif("total", F.lit(0.0)) * 100).alias(f"{s}_pct")
                for s in streams
            ],
        )
    )


def peak_month(forecast: DataFrame) -> DataFrame:
    """Month with the highest forecast, the earliest on a tie, and the mean."""
    return forecast.groupBy("series_id").agg(
        F.min_by("month", F.struct(-F.col("yhat"), F.col("month"))).alias("peak_month"),
        F.max("yhat").alias("peak"),
        F.avg("yhat").alias("average"),
    )


def trend_caution(total: DataFrame, ratio: float = 0.97) -> DataFrame:
    """Warns when the last forecast month lies below 97 % of the first."""
    return total.agg(
        F.min_by("base", "step").alias("first_base"), F.max_by("base", "step").alias("last_base")
    ).withColumn("declining", F.col("last_base") < F.col("first_base") * ratio)


def quarterly_scenarios(total: DataFrame, full_only: bool = False) -> DataFrame:
    """Scenario sums per quarter; ``full_only`` leaves out quarters with fewer than 3 months."""
    quarterly = total.groupBy(
        F.year("month").alias("year"), F.quarter("month").alias("quarter")
    ).agg(
        F.count("*").alias("months"),
        *[F.round(F.sum(s), 2).alias(s) for s in ("bear", "base", "bull")],
    )
    return quarterly.filter(F.col("months") == 3) if full_only else quarterly


def annual_totals(total: DataFrame) -> DataFrame:
    """Scenario sums over the whole horizon."""
    return total.agg(
        F.count("*").alias("months"),
        *[F.round(F.sum(s), 2).alias(s) for s in ("bear", "base", "bull")],
    )


def stream_mix(forecast: DataFrame) -> DataFrame:
    """Share of every stream in the forecast, in percent."""
    per_stream = forecast.groupBy("series_id").agg(F.sum("yhat").alias("_sum"))
    overall = per_stream.agg(F.sum("_sum")).scalar()
    return per_stream.select(
        "series_id",
        F.round("_sum", 2).alias("forecast_sum"),
        (F.col("_sum") / F.nullif(overall, F.lit(0.0)) * 100).alias("share_pct"),
    )


def cumulative_scenarios(total: DataFrame) -> DataFrame:
    """Running scenario sums over one forecast's months (at most the horizon)."""
    running = (
        Window.partitionBy(F.lit(TOTAL))
        .orderBy("month")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return total.select(
        "month",
        "bear",
        "base",
        "bull",
        *[F.round(F.sum(s).over(running), 2).alias(f"{s}_cum") for s in ("bear", "base", "bull")],
    )


def spread_bands(total: DataFrame) -> DataFrame:
    """Bear to Bull spread of every month with its band relative to the widest month, the
    distances from Base, and a closing total row. One forecast's months only."""
    month_rows = total.select(
        F.date_format("month", "yyyy-MM-dd").alias("period"), "bear", "base", "bull",
        F.col("month").isNull().alias("is_total"),
    )
    total_row = total.select(
        F.lit("TOTAL").alias("period"),
        *[F.sum(s).alias(s) for s in ("bear", "base", "bull")],
        F.lit(True).alias("is_total"),
    )
    spread = F.round(F.col("bull") - F.col("bear"), 2)
    widest = F.max(F.when(~F.col("is_total"), F.col("spread"))).over(
        Window.partitionBy(F.lit(TOTAL))
    )
    relative = F.col("spread") / F.nullif("widest", F.lit(0.0))
    return (
        month_rows.unionByName(total_row)
        .withColumn("spread", spread)
        .withColumn("widest", widest)
        .select(
            "period",
            *[F.round(s, 2).alias(s) for s in ("bear", "base", "bull")],
            "spread",
            F.round(F.col("bear") - F.col("base"), 2).alias("downside"),
            F.round(F.col("bull") - F.col("base"), 2).alias("upside"),
            F.when(relative < 0.35, "low")
            .when(relative < 0.70, "medium")
            .otherwise("high")
            .alias("band"),
        )
    )
