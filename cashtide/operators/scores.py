"""Accuracy scores, residual diagnostics and autocorrelation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.functions import folds
from cashtide.functions.correlation import autocorrelation, levinson
from cashtide.functions.normality import shapiro_wilk_p
from cashtide.functions.tails import chi_square_tail

WINKLER_ALPHA = 0.20


def winkler_term(y: Column, lo: Column, hi: Column, alpha: float = WINKLER_ALPHA) -> Column:
    """Width of an interval plus 2/alpha times how far the actual lies outside."""
    miss = F.when(y < lo, lo - y).when(y > hi, y - hi).otherwise(F.lit(0.0))
    return F.when(lo.isNotNull() & hi.isNotNull(), (hi - lo) + miss * (2 / alpha))


def _score_aggregates() -> list[Column]:
    error = F.col("y") - F.col("yhat")
    return [
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.max("scale").alias("scale"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(winkler_term(F.col("y"), F.col("lo80"), F.col("hi80"))).alias("winkler80"),
    ]


def _residuals() -> Column:
    ordered = F.array_sort(
        F.collect_list(
            F.struct("train_end", "step", (F.col("y") - F.col("yhat")).alias("residual"))
        )
    )
    return F.transform(ordered, lambda r: r["residual"]).alias("residuals")


def score(results: DataFrame) -> DataFrame:
    """MASE, RMSE and Winkler score of every series and model, pooled over all origins."""
    scored = results.groupBy("series_id", "model").agg(*_score_aggregates())
    return scored.withColumn("mase", F.col("mae") / F.col("scale"))


def residual_arrays(results: DataFrame) -> DataFrame:
    """Residuals per series and model in order of origin and step: windows x season values."""
    return results.groupBy("series_id", "model").agg(_residuals())


def score_with_residuals(results: DataFrame) -> DataFrame:
    """:func:`score` and :func:`residual_arrays` by one grouping, so that the backtests are read once."""
    both = results.groupBy("series_id", "model").agg(*_score_aggregates(), _residuals())
    return both.withColumn("mase", F.col("mae") / F.col("scale"))


def acf(arrays: DataFrame, max_lag: int = 24) -> DataFrame:
    """Autocorrelation of every series up to ``max_lag``."""
    return arrays.withColumn(
        "acf", autocorrelation(F.col("ys"), F.sequence(F.lit(0), F.lit(max_lag)))
    ).select("series_id", F.posexplode("acf").alias("lag", "acf"))


def pacf(arrays: DataFrame, max_lag: int = 24) -> DataFrame:
    """Partial autocorrelation (Yule-Walker) of every series up to ``max_lag``."""
    lags = F.sequence(F.lit(0), F.lit(max_lag))
    return (
        arrays.select("series_id", autocorrelation(F.col("ys"), lags).alias("rho"))
        .withColumn("pacf", levinson(F.col("rho"), max_lag))
        .select("series_id", F.posexplode("pacf").alias("lag", "pacf"))
        .withColumn("lag", F.col("lag") + 1)
    )


def ljung_box(residuals: DataFrame, max_lags: int = 12) -> DataFrame:
    """Ljung-Box Q for every lag from 1 to min(12, n div 5); series with n < 10 have none."""
    n = F.size("residuals")
    lags = F.least(F.lit(max_lags), F.greatest(F.lit(1), F.floor(n / 5).cast("int")))
    return (
        residuals.filter(n >= 10)
        .withColumn("n", n)
        .withColumn(
            "rho", autocorrelation(F.col("residuals"), F.sequence(F.lit(1), lags))
        )
        .withColumn(
            "terms",
            F.transform("rho", lambda r, i: r * r / (F.col("n") - i - 1)),
        )
        .select("series_id", "model", "n", "terms", F.posexplode("terms").alias("lag", "_term"))
        .select(
            "series_id",
            "model",
            (F.col("lag") + 1).alias("lag"),
            (
                F.col("n")
                * (F.col("n") + 2)
                * folds.total(F.slice("terms", F.lit(1), F.col("lag") + 1))
            ).alias("q"),
        )
    )


def ljung_box_p(q_by_lag: DataFrame) -> DataFrame:
    """Smallest Ljung-Box p-value over the lags of every series and model."""
    return (
        q_by_lag.withColumn("p", chi_square_tail(F.col("q"), F.col("lag")))
        .groupBy("series_id", "model")
        .agg(F.min("p").alias("ljung_box_p"))
    )


def normality(residuals: DataFrame, limit: int = 5000) -> DataFrame:
    """Shapiro-Wilk p-value per series and model, NULL beyond ``limit`` residuals.

    The limit belongs to the test: its approximation holds up to that sample size, and no part is tested instead.
    """
    return residuals.select(
        "series_id",
        "model",
        shapiro_wilk_p(F.when(F.size("residuals") <= limit, F.col("residuals"))).alias("shapiro_p"),
    )
