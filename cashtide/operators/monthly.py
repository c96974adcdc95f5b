"""Charges to monthly series.

Three shapes are used, all keyed by ``series_id``:

* *sums*   ``(series_id, month, y)``, only months with charges;
* *array*  ``(series_id, first_month, ys)``, one row per series, every calendar month present;
* *long*   ``(series_id, month, idx, y)``, the array exploded.

Raw charges are reduced to sums by map-side partial aggregation, so a series that holds a large
part of all charges costs one row per month and task in the shuffle. After that a series has at
most one row per calendar month, which bounds every later per-series group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashtide.settings import Settings


def month_of(moment: Column) -> Column:
    return F.trunc(moment, "MM")


def months_between(first: Column, later: Column) -> Column:
    """Whole calendar months from ``first`` to ``later``, both month starts."""
    return F.months_between(later, first).cast("int")


def since_start(charges: DataFrame, settings: Settings) -> DataFrame:
    """Charges from the first month on; a plain comparison, so the scan can skip data."""
    start = F.lit(settings.series_start.isoformat()).cast("timestamp_ntz")
    return charges.filter(F.col("created") >= start)


def monthly_sums(charges: DataFrame, settings: Settings, by: str = "category") -> DataFrame:
    """Revenue per series and month, summed exactly."""
    return (
        since_start(charges, settings)
        .groupBy(F.col(by).alias("series_id"), month_of(F.col("created")).alias("month"))
        .agg(F.sum("amount").alias("y"))
    )


def monthly_sums_via(
    charges: DataFrame, groups: DataFrame, settings: Settings, key: str = "payer"
) -> DataFrame:
    """Revenue per series and month where ``groups(key, series_id)`` names the series.

    Charges are summed per key and month before the join. A key that holds a third of all rows
    then enters the join with one row per month instead of skewing it.
    """
    cells = (
        since_start(charges, settings)
        .groupBy(key, month_of(F.col("created")).alias("month"))
        .agg(F.sum("amount").alias("y"))
    )
    return cells.join(groups, key).groupBy("series_id", "month").agg(F.sum("y").alias("y"))


def last_month(sums: DataFrame, settings: Settings) -> Column:
    """Last month of all series: the last complete one, or earlier if the data ends earlier.

    The sum takes part in the aggregate so that this plan equals the one of the caller up to the
    shuffle; Spark then reuses that shuffle and reads the charges once.
    """
    seen = sums.agg(F.max(F.struct("month", "y"))["month"]).scalar()
    return F.least(F.lit(settings.last_complete_month), seen)


def calendar_length(sums: DataFrame, settings: Settings) -> Column:
    """Number of months in the calendar all series share."""
    return months_between(F.lit(settings.series_start), last_month(sums, settings)) + 1


def demand_months(sums: DataFrame, settings: Settings) -> DataFrame:
    """Months with revenue as ``(series_id, idx, y)``, the empty ones not filled in.

    Months outside the calendar have no value instead of being filtered out: a filter would move
    below the aggregation, and :func:`last_month` could no longer share its shuffle.
    """
    counts = (F.col("month") <= F.lit(settings.last_complete_month)) & (F.col("y") > 0)
    return sums.select(
        "series_id",
        months_between(F.lit(settings.series_start), F.col("month")).alias("idx"),
        F.when(counts, F.col("y").cast("double")).alias("y"),
    )


def series_arrays(
    sums: DataFrame,
    settings: Settings,
    end: Column | None = None,
    streams: Sequence[str] | None = None,
) -> DataFrame:
    """One row per series with a value for every month; months without charges are 0.

    ``streams`` names series that must be present even without any charge.
    """
    start = F.lit(settings.series_start)
    if streams is not None:
        # Before the last month is taken: both must read the same plan to share its shuffle.
        sums = sums.filter(F.col("series_id").isin(*streams))
    end = last_month(sums, settings) if end is None else end
    cells = sums.select(
        "series_id",
        months_between(start, F.col("month")).alias("idx"),
        F.col("y").cast("double").alias("y"),
    )
    if streams is not None:
        # A position before the first month announces the series and is never read.
        announced = sums.sparkSession.createDataFrame(
            [(s, -1, 0.0) for s in streams], "series_id string, idx int, y double"
        )
        cells = cells.unionByName(announced)
    return (
        cells.groupBy("series_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("idx", "y"))).alias("by_idx"))
        .withColumn("last_idx", F.greatest(months_between(start, end), F.lit(0)))
        .select(
            "series_id",
            start.alias("first_month"),
            F.transform(
                F.sequence(F.lit(0), F.col("last_idx")),
                lambda i: F.coalesce(F.try_element_at("by_idx", i), F.lit(0.0)),
            ).alias("ys"),
        )
    )


def to_long(arrays: DataFrame) -> DataFrame:
    """Series arrays back to one row per month."""
    return arrays.select(
        "series_id", "first_month", F.posexplode("ys").alias("idx", "y")
    ).select("series_id", F.add_months("first_month", F.col("idx")).alias("month"), "idx", "y")


def fill_calendar(
    sums: DataFrame,
    settings: Settings,
    end: Column | None = None,
    streams: Sequence[str] | None = None,
) -> DataFrame:
    """Monthly sums with the empty months filled in as 0."""
    return to_long(series_arrays(sums, settings, end, streams))


def widen(long: DataFrame, streams: Sequence[str], value: str = "y") -> DataFrame:
    """One column per stream and one row per month; a stream without rows is 0 throughout."""
    return (
        long.groupBy("month")
        .pivot("series_id", list(streams))
        .agg(F.first(value))
        .select("month", *[F.coalesce(F.col(f"`{s}`"), F.lit(0.0)).alias(s) for s in streams])
    )


def unpivot_streams(wide: DataFrame, streams: Sequence[str]) -> DataFrame:
    """One row per stream and month."""
    return wide.unpivot(["month"], list(streams), "series_id", "y")


def add_features(wide: DataFrame, settings: Settings) -> DataFrame:
    """Disruption flag, log1p of every stream, and the total over the streams."""
    streams = settings.streams
    total = sum((F.col(s) for s in streams[1:]), F.col(streams[0]))
    return wide.select(
        "*",
        is_disrupted(F.col("month"), settings).cast("int").alias("disrupted"),
        *[F.log1p(F.col(s)).alias(f"{s}_log") for s in streams],
        total.alias("total"),
    )


def is_disrupted(month: Column, settings: Settings) -> Column:
    return month < F.lit(settings.disruption_end)


def undo_log(value: Column) -> Column:
    """Inverse of the log1p feature."""
    return F.expm1(value)


def history_tail(long: DataFrame, months: int = 36) -> DataFrame:
    """The last months of every series."""
    latest = Window.partitionBy("series_id").orderBy(F.desc("month"))
    return (
        long.withColumn("_age", F.row_number().over(latest))
        .filter(F.col("_age") <= months)
        .drop("_age")
    )
