"""Model selection, the evaluation table, its grades and the regression gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.operators.profiles import SPARSE_BELOW

BENCHMARK = "seasonal_naive"

# Stream -> (default, challenger). The challenger must be strictly better.
DEFAULT_PAIRS: dict[str, tuple[str, ...]] = {
    "league": ("ensemble", "croston"),
    "recurring": ("ensemble", "level"),
    "one_time": ("level", "ensemble"),
}


def preference(series: Column, model: Column, pairs: Mapping[str, Sequence[str]]) -> Column:
    """Rank of a model among the candidates of its series; NULL when it is no candidate."""
    rank = F.lit(None).cast("int")
    for name, models in pairs.items():
        for position, candidate in enumerate(models):
            rank = F.when((series == name) & (model == candidate), position).otherwise(rank)
    return rank


def ranked_by(model: Column, order: Sequence[str]) -> Column:
    """Rank by one order shared by all series."""
    rank = F.lit(None).cast("int")
    for position, candidate in enumerate(order):
        rank = F.when(model == candidate, position).otherwise(rank)
    return rank


def select_model(scores: DataFrame, rank: Column, benchmark: str = BENCHMARK) -> DataFrame:
    """The candidate with the lowest MASE; a tie, or an undefined MASE on either side, keeps the preferred one.

    ``baseline`` is the MASE of the benchmark. Choice and benchmark come from one grouping, so
    the scores, and the backtests below them, are computed once.
    """
    undefined = F.lit(float("inf"))
    order = F.when(
        F.col("_rank").isNotNull(),
        F.struct(F.coalesce("mase", F.when(F.col("_rank") == 0, -undefined).otherwise(undefined)), "_rank"),
    )
    best = F.min_by(F.struct("model", "mase", "rmse", "winkler80"), order)
    baseline = F.max(F.when(F.col("model") == benchmark, F.col("mase")))
    return (
        scores.withColumn("_rank", rank)
        .groupBy("series_id")
        .agg(best.alias("best"), baseline.alias("baseline"))
        .filter(F.col("best").isNotNull())
        .select("series_id", "best.*", "baseline")
    )


def evaluation(selected: DataFrame) -> DataFrame:
    """Scores of the selected models next to the benchmark, rounded for publication."""
    beats = F.coalesce(F.col("mase") < F.col("baseline"), F.lit(False))
    return selected.select(
        "series_id",
        "model",
        F.round("mase", 4).alias("mase"),
        F.round("rmse", 2).alias("rmse"),
        F.round("winkler80", 2).alias("winkler80"),
        F.round("baseline", 4).alias("baseline_mase"),
        beats.alias("beats_baseline"),
    )


def for_every_series(table: DataFrame, arrays: DataFrame, sparse_below: float = SPARSE_BELOW) -> DataFrame:
    """Adds the series that no backtest could score, without scores and with the model their sparsity asks for."""
    share = F.size(F.filter("ys", lambda y: y > 0)) / F.size("ys")
    route = F.when(share >= sparse_below, "level").otherwise("croston")
    routed = arrays.select("series_id", route.alias("_route")).join(table, "series_id", "left")
    return routed.select(
        "series_id",
        F.coalesce("model", "_route").alias("model"),
        *[c for c in table.columns if c not in ("series_id", "model", "beats_baseline")],
        F.coalesce("beats_baseline", F.lit(False)).alias("beats_baseline"),
    ).select(*table.columns)


def with_diagnostics(table: DataFrame, whiteness: DataFrame, normal: DataFrame) -> DataFrame:
    """Adds Ljung-Box and Shapiro-Wilk p-values of the selected model, with their verdicts."""
    keys = ["series_id", "model"]
    return (
        table.join(whiteness, keys, "left")
        .join(normal, keys, "left")
        .withColumn("residuals_white_noise", F.col("ljung_box_p") > 0.05)
        .withColumn("residuals_normal", F.col("shapiro_p") > 0.05)
        .withColumn("ljung_box_p", F.round("ljung_box_p", 4))
        .withColumn("shapiro_p", F.round("shapiro_p", 4))
    )


def beats_summary(table: DataFrame) -> DataFrame:
    """How many models beat the benchmark."""
    return table.agg(
        F.count_if("beats_baseline").alias("beating"), F.count("*").alias("models")
    )


def accuracy_grade(table: DataFrame, baselines: DataFrame) -> DataFrame:
    """Grade of every model, its distance to the benchmark, and the error against the average.

    ``baselines(series_id, mean_positive)`` is the stream's mean positive month.
    """
    beats, mase, base = F.col("beats_baseline"), F.col("mase"), F.col("baseline_mase")
    grade = (
        F.when(beats, "beats benchmark")
        .when(mase < base * 1.5, "near benchmark")
        .otherwise("trajectory only")
    )
    gap = F.when(beats, base - mase).otherwise(mase - base) / F.nullif(base, F.lit(0.0)) * 100
    average = F.coalesce("mean_positive", F.lit(1.0))
    return table.join(baselines.select("series_id", "mean_positive"), "series_id", "left").select(
        "series_id",
        "model",
        grade.alias("grade"),
        F.coalesce(beats & (mase < 1.3), F.lit(False)).alias("strong"),
        gap.alias("gap_pct"),
        F.when(average > 0, F.col("rmse") / average * 100).otherwise(F.lit(0.0)).alias("error_pct"),
    )


class RegressionError(RuntimeError):
    """Raised when a forecast got worse and no longer beats the benchmark."""


DEFAULT_RATIO = 1.30


def regression_report(
    table: DataFrame, prior: DataFrame, ratio: float = DEFAULT_RATIO
) -> DataFrame:
    """Verdict per series against ``prior(series_id, prior_mase)``.

    ``hard``: worse than ``ratio`` times the prior MASE and worse than the benchmark; ``soft``:
    only the first; ``ok``: within tolerance; ``skipped``: nothing to compare.
    """
    observed = F.col("mase") / F.nullif("prior_mase", F.lit(0.0))
    comparable = (
        F.col("mase").isNotNull() & F.col("prior_mase").isNotNull() & (F.col("prior_mase") > 0)
    )
    worse_than_benchmark = F.coalesce(F.col("mase") > F.col("baseline_mase"), F.lit(False))
    verdict = (
        F.when(~F.coalesce(comparable, F.lit(False)), "skipped")
        .when(observed <= ratio, "ok")
        .when(worse_than_benchmark, "hard")
        .otherwise("soft")
    )
    return table.join(prior, "series_id", "left").select(
        "series_id",
        "prior_mase",
        "mase",
        "baseline_mase",
        F.when(comparable, observed).alias("ratio"),
        verdict.alias("verdict"),
    )


def regression_gate(table: DataFrame, prior: DataFrame | None, ratio: float = DEFAULT_RATIO) -> DataFrame:
    """The soft regressions; raises when there is any hard one. Call it before any write.

    Without a prior run there is nothing to compare and nothing is returned.
    """
    if prior is None:
        return table.sparkSession.createDataFrame(
            [], "series_id string, prior_mase double, mase double, baseline_mase double, "
            "ratio double, verdict string"
        )
    report = regression_report(table, prior, ratio)
    hard = report.filter(F.col("verdict") == "hard")
    totals = hard.agg(
        F.count("*").alias("n"), F.min_by(F.struct("*"), F.col("ratio") * -1).alias("worst")
    ).first()
    if totals["n"]:
        w = totals["worst"]
        raise RegressionError(
            f"{totals['n']} series regressed beyond {ratio:.2f}x and below the benchmark; worst: "
            f"{w['series_id']} from {w['prior_mase']:.3f} to {w['mase']:.3f} ({w['ratio']:.2f}x)"
        )
    return report.filter(F.col("verdict") == "soft")
