"""Outlier flags on monthly series, in one shuffle: every window shares partition and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashtide.settings import Settings

MAD_TO_SIGMA = 1.4826  # Fixed value: consistency of the MAD for a normal distribution
PIPELINE_SIGMA = 4.5
MAX_OUTLIERS = 5


def _around(width: int):
    half = width // 2
    return Window.partitionBy("series_id").orderBy("month").rowsBetween(-half, half)


def rolling_median(long: DataFrame, value: str = "y", width: int = 5, out: str = "median") -> DataFrame:
    """Centred rolling median; at the edges over the months that exist."""
    return long.withColumn(out, F.percentile(value, 0.5).over(_around(width)))


def hampel_flags(
    long: DataFrame, value: str = "y", width: int = 5, n_sigma: float = 3.0
) -> DataFrame:
    """Months whose deviation from their own rolling median exceeds ``n_sigma`` robust sigmas.

    The spread is the rolling median of those deviations, each taken from the median of its own
    window rather than from the one of the flagged month.
    """
    deviated = rolling_median(long, value, width).withColumn(
        "deviation", F.abs(F.col(value) - F.col("median"))
    )
    return rolling_median(deviated, "deviation", width, out="mad").withColumn(
        "flagged", F.col("deviation") > F.lit(n_sigma * MAD_TO_SIGMA) * F.col("mad")
    )


def keep_strongest(
    flagged: DataFrame, value: str = "y", limit: int = MAX_OUTLIERS
) -> DataFrame:
    """When a series has more than ``limit`` flags, keep those among its ``limit`` largest values.

    All months are ranked, flagged or not, so fewer than ``limit`` flags may remain.
    """
    strongest = Window.partitionBy("series_id").orderBy(F.abs(F.col(value)).desc(), F.desc("month"))
    whole = Window.partitionBy("series_id")
    ranked = flagged.withColumn("_rank", F.row_number().over(strongest)).withColumn(
        "_flags", F.sum(F.col("flagged").cast("int")).over(whole)
    )
    kept = F.col("flagged") & ((F.col("_flags") <= limit) | (F.col("_rank") <= limit))
    return ranked.withColumn("outlier", kept).drop("_rank", "_flags")


def outlier_indicators(long: DataFrame, outliers: DataFrame) -> DataFrame:
    """1 for the months listed in ``outliers(series_id, month)``, else 0."""
    marks = outliers.select("series_id", "month").distinct().withColumn("_hit", F.lit(1))
    return (
        long.join(marks, ["series_id", "month"], "left")
        .withColumn("indicator", F.coalesce("_hit", F.lit(0)))
        .drop("_hit")
    )


def indicator_columns(long: DataFrame, months: list) -> DataFrame:
    """Wide form: one 0/1 column per flagged month, named ``outlier_yyyymm``."""
    return long.select(
        "*",
        *[
            (F.col("month") == F.lit(m)).cast("double").alias(f"outlier_{m:%Y%m}")
            for m in months
        ],
    )


def first_break(breaks: DataFrame) -> DataFrame:
    """First break month of every series."""
    return breaks.groupBy("series_id").agg(F.min("month").alias("break_month"))


def after_break(month: Column, break_month: Column) -> Column:
    """0 before the break and 1 from it on; NULL, that is no regressor, without a break."""
    return F.when(break_month.isNotNull(), (month >= break_month).cast("double"))


def step_dummy(long: DataFrame, first_breaks: DataFrame) -> DataFrame:
    """Adds ``post_break`` to every month of every series."""
    return long.join(first_breaks, "series_id", "left").withColumn(
        "post_break", after_break(F.col("month"), F.col("break_month"))
    )


def outlier_context(long: DataFrame, outliers: DataFrame, settings: Settings) -> DataFrame:
    """Flagged months with the stream's median positive month after the disruption.

    The median is a window value over the series, so the flags join once and nothing is
    broadcast.
    """
    calm = F.when((F.col("month") >= F.lit(settings.disruption_end)) & (F.col("y") > 0), F.col("y"))
    with_median = long.withColumn(
        "stream_median", F.percentile(calm, 0.5).over(Window.partitionBy("series_id"))
    )
    above = (F.col("y") - F.col("stream_median")) / F.col("stream_median") * 100
    return (
        with_median.join(outliers.select("series_id", "month"), ["series_id", "month"])
        .withColumn("pct_above", F.when(F.col("stream_median") > 0, above))
        .select("series_id", "month", "y", "stream_median", "pct_above")
    )
