"""Audit and profile tables over charges and monthly series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cashtide.settings import Settings

SPARSE_BELOW = 0.60


def money(column: Column) -> Column:
    """Exact money as a double with two decimals."""
    return F.round(column, 2).cast("double")


def amount_aggregates(amount: Column) -> list[Column]:
    """Count, sum, min and max of the amounts: all a run needs of them."""
    return [
        F.count(amount).alias("transactions"),
        F.sum(amount).alias("total"),
        F.min(amount).alias("smallest"),
        F.max(amount).alias("largest"),
    ]


def amount_cells(charges: DataFrame, *keys: str | Column) -> DataFrame:
    """Count, sum, min and max of the amounts per key."""
    return charges.groupBy(*keys).agg(*amount_aggregates(F.col("amount")))


def category_summary(charges: DataFrame) -> DataFrame:
    """Audit of the cleaned charges per category."""
    return summarise_cells(amount_cells(charges, "category"))


def summarise_cells(cells: DataFrame) -> DataFrame:
    """Count, sum, mean, min and max per category, and the share of the rounded totals.

    The share is a window over the finished category rows. There are as many as there are
    rules, so one task is enough, and the charges are read once.
    """
    per_category = cells.groupBy("category").agg(
        F.sum("transactions").alias("transactions"),
        F.sum("total").cast("decimal(38,2)").alias("total"),
        F.min("smallest").alias("smallest"),
        F.max("largest").alias("largest"),
    )
    rounded = per_category.select(
        "category",
        "transactions",
        money(F.col("total")).alias("total"),
        F.round(F.col("total").cast("double") / F.col("transactions"), 2).alias("average"),
        money(F.col("smallest")).alias("smallest"),
        money(F.col("largest")).alias("largest"),
    )
    exact = F.sum(F.col("total").cast("decimal(38,2)")).over(Window.partitionBy(F.lit(0)))
    overall = F.nullif(exact.cast("double"), F.lit(0.0))
    return rounded.withColumn("share_pct", F.round(F.col("total") / overall * 100, 1))


def by_total(summary: DataFrame) -> DataFrame:
    """Largest category first. For publishing; the order means nothing to later operators."""
    return summary.orderBy(F.desc("total"), "category")


def series_profile(long: DataFrame) -> DataFrame:
    """Total, non-zero months, range and last month of every series."""
    return long.groupBy("series_id").agg(
        F.round(F.sum("y"), 2).alias("total"),
        F.count_if(F.col("y") > 0).alias("nonzero_months"),
        F.count("*").alias("months"),
        F.min("y").alias("lowest"),
        F.max("y").alias("highest"),
        F.min("month").alias("first_month"),
        F.max("month").alias("data_through"),
    )


def sparsity_route(
    demand: DataFrame, n_months: Column, sparse_below: float = SPARSE_BELOW
) -> DataFrame:
    """Share of non-zero months; sparse series go to Croston, the others to the level model.

    ``demand`` holds the months with revenue only, so empty months are never materialised.
    """
    return (
        demand.groupBy("series_id")
        .agg(F.count_if(F.col("y") > 0).alias("nonzero_months"))
        .withColumn("nonzero_frac", F.col("nonzero_months") / n_months)
        .withColumn(
            "route", F.when(F.col("nonzero_frac") >= sparse_below, "level").otherwise("croston")
        )
    )


def model_spec(arrays: DataFrame, chosen: DataFrame) -> DataFrame:
    """Series, model, months trained on and share of non-zero months in percent."""
    facts = arrays.select(
        "series_id",
        F.size("ys").alias("n_train"),
        F.round(
            F.size(F.filter("ys", lambda y: y > 0)) / F.size("ys") * 100, 0
        ).cast("int").alias("nonzero_pct"),
    )
    return facts.join(chosen.select("series_id", "model"), "series_id")


def stream_baselines(long: DataFrame, settings: Settings) -> DataFrame:
    """After the disruption: mean of all months, mean and median of the positive ones.

    Revenue is never negative, so both means share one sum.
    """
    earned = F.when(F.col("y") > 0, F.col("y"))
    # Money is added exactly, so the means do not depend on the order of the months.
    exact = F.sum(F.col("y").cast("decimal(18,2)")).cast("double")
    return (
        long.filter(F.col("month") >= F.lit(settings.disruption_end))
        .groupBy("series_id")
        .agg(
            (exact / F.count("*")).alias("mean_all"),
            (exact / F.nullif(F.count(earned), F.lit(0))).alias("mean_positive"),
            F.percentile(earned, 0.5).alias("median_positive"),
        )
    )
