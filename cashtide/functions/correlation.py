"""Autocorrelation and partial autocorrelation of one series' array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashtide.functions import folds


def autocorrelation(values: Column, lags: Column) -> Column:
    """Autocorrelations for an array of lags; NULL for a constant array.

    Deviations that are rounding noise next to the values count as none.
    """
    size = folds.total(F.transform(values, lambda v: v * v))

    def of(d: Column) -> Column:
        squares = folds.total(F.transform(d, lambda x: x * x))
        power = folds.let(squares, lambda s: F.when(s > size * 1e-24, s))

        def at(lag: Column, total: Column) -> Column:
            kept = F.greatest(F.size(d) - lag, F.lit(0))
            products = F.zip_with(
                F.slice(d, F.lit(1), kept), F.slice(d, lag + 1, kept), lambda a, b: a * b
            )
            return folds.total(products) / total

        return folds.let(power, lambda total: F.transform(lags, lambda lag: at(lag, total)))

    deviations = folds.let(
        values,
        lambda v: folds.let(folds.mean(v), lambda m: F.transform(v, lambda x: x - m)),
    )
    return folds.let(deviations, of)


def levinson(rho: Column, max_lag: int) -> Column:
    """Partial autocorrelations for lags 1.. from autocorrelations for lags 0.. .

    Levinson-Durbin recursion as a fold: the state holds the coefficients of the current order.
    """
    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), F.lit(1.0).alias("v"), empty.alias("out"))

    def step(acc: Column, k: Column, r: Column) -> Column:
        backwards = F.reverse(F.slice(r, F.lit(2), k - 1))
        explained = folds.total(F.zip_with(acc["phi"], backwards, lambda p, q: p * q))
        reflection = (F.get(r, k) - explained) / F.nullif(acc["v"], F.lit(0.0))
        return folds.let(
            reflection,
            lambda a: F.struct(
                F.concat(
                    F.zip_with(acc["phi"], F.reverse(acc["phi"]), lambda p, q: p - a * q),
                    F.array(a),
                ).alias("phi"),
                (acc["v"] * (F.lit(1.0) - a * a)).alias("v"),
                F.concat(acc["out"], F.array(a)).alias("out"),
            ),
        )

    return folds.let(
        rho,
        lambda r: F.aggregate(
            F.sequence(F.lit(1), F.lit(max_lag)),
            start,
            lambda acc, k: step(acc, k, r),
            lambda acc: acc["out"],
        ),
    )
