"""Distribution drift between a reference and a current sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-6  # Fixed value: share given to a value that one sample lacks
DRIFT_THRESHOLD = 0.2
#: Bins of continuous columns, and the accuracy of the sketches that place them.
BINS, SKETCH_ACCURACY = 10, 100_000
REFERENCE, CURRENT = "reference", "current"


def value_counts(
    samples: DataFrame,
    columns: Sequence[str],
    period: str = "period",
    weight: str | None = None,
) -> DataFrame:
    """Occurrences per column, value and period. NULLs are left out.

    A row stands for ``weight`` occurrences, so samples may be counted beforehand.

    Counting is the only pass over the raw rows, and map-side partial aggregation leaves one row
    per distinct value and task, so a value that holds a third of all rows costs no more than
    any other.
    """
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    seen = lambda label: F.sum(F.when(F.col("period") == label, F.col("times")).otherwise(0))
    return (
        samples.select(F.col(period).alias("period"), times.alias("times"), F.inline(cells))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(
            seen(REFERENCE).alias("n_ref"),
            seen(CURRENT).alias("n_cur"),
        )
    )


def psi(
    samples: DataFrame,
    columns: Sequence[str],
    period: str = "period",
    weight: str | None = None,
) -> DataFrame:
    """Population stability index of every column over the values either sample holds."""
    return _index(value_counts(samples, columns, period, weight), "values")


def _index(counts: DataFrame, groups: str) -> DataFrame:
    """The index of every column from ``counts(column, n_ref, n_cur)``, a row for each value or bin."""
    totals = counts.groupBy("column").agg(
        F.sum("n_ref").alias("all_ref"), F.sum("n_cur").alias("all_cur")
    )
    share = lambda n, total: F.greatest(F.col(n) / F.nullif(total, F.lit(0)), F.lit(EPSILON))
    ref, cur = share("n_ref", "all_ref"), share("n_cur", "all_cur")
    # One row per named column: the list of columns bounds what is broadcast, and a column with
    # very many values does not end up in one task.
    return (
        counts.join(F.broadcast(totals), "column")
        .groupBy("column")
        .agg(
            F.sum((cur - ref) * F.log(cur / ref)).alias("psi"),
            F.count("*").alias(groups),
            F.max("all_ref").alias("reference_rows"),
            F.max("all_cur").alias("current_rows"),
        )
    )


def _numbers(columns: Sequence[str]) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))


def bin_edges(
    samples: DataFrame, columns: Sequence[str], bins: int = BINS, period: str = "period", accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """Per column the upper edges of all bins but the last: quantiles of the reference period, equal ones once.

    Quantiles come from sketches that tasks merge: the rank of an edge is off by a share of 1 / ``accuracy`` at most, and
    exact while a column has fewer rows than half of that.
    """
    cuts = [i / bins for i in range(1, bins)]
    return (
        samples.where(F.col(period) == REFERENCE)
        .select(_numbers(columns))
        .where(F.col("value").isNotNull())
        .groupBy("column")
        .agg(F.array_distinct(F.percentile_approx("value", cuts, accuracy)).alias("edges"))
    )


def psi_binned(
    samples: DataFrame, columns: Sequence[str], bins: int = BINS, period: str = "period", accuracy: int = SKETCH_ACCURACY
) -> DataFrame:
    """Population stability index of continuous columns, over at most ``bins`` bins that hold equal parts of the reference.

    Exact values of two samples of one law hardly meet, so :func:`psi` sees drift in them and its table grows with the
    rows; bins do neither. A value belongs to the first bin whose edge it does not exceed, the last bin is open, NaN lies in it.
    NULLs are left out. A column without any reference value has one bin. Two passes: the sketch, the counts.
    """
    edges = bin_edges(samples, columns, bins, period, accuracy)
    seen = lambda label: F.count_if(F.col("period") == label)
    counts = (
        samples.select(F.col(period).alias("period"), _numbers(columns))
        .where(F.col("value").isNotNull())
        # A row for each named column.
        .join(F.broadcast(edges), "column", "left")
        .select("column", "period", F.size(F.filter(F.coalesce("edges", F.array().cast("array<double>")), lambda e: e < F.col("value"))).alias("bin"))
        .groupBy("column", "bin")
        .agg(seen(REFERENCE).alias("n_ref"), seen(CURRENT).alias("n_cur"))
    )
    return _index(counts, "bins")


def drift_report(scores: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Drift verdict per column, with the number and share of drifted columns on every row."""
    judged = scores.withColumn("drifted", F.col("psi") >= threshold)
    summary = judged.agg(
        F.count_if("drifted").alias("drifted_columns"),
        (F.count_if("drifted") / F.nullif(F.count("*"), F.lit(0))).alias("drifted_share"),
    )
    lines = judged.select(F.col("column"), "psi", "drifted").withColumn(
        "threshold", F.lit(threshold)
    )
    # One summary row, read as scalars.
    return lines.withColumn("drifted_columns", summary.select("drifted_columns").scalar()).withColumn(
        "drifted_share", summary.select("drifted_share").scalar()
    )
