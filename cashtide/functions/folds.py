"""Recursive estimators as JVM-side folds over one series' array of monthly values.

An array never holds more than one value per calendar month, so its length is set by the
calendar, not by the number of charges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CROSTON_ALPHA = 0.15
LEVEL_DECAY = 0.75  # weight of a month relative to the following one


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body reads it.

    Expressions inside lambdas are not shared by the optimizer; a one-element transform binds
    the value to a variable.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _zero() -> Column:
    return F.lit(0.0)


def not_negative(value: Column) -> Column:
    """Clipped at 0. Unlike ``greatest``, a missing value stays missing."""
    return F.when(value < 0, _zero()).otherwise(value)


def total(values: Column) -> Column:
    return F.aggregate(values, _zero(), lambda acc, v: acc + v)


def mean(values: Column) -> Column:
    """Mean, NULL for an empty array."""
    return total(values) / F.nullif(F.size(values), F.lit(0))


def pop_std(values: Column) -> Column:
    """Population standard deviation, NULL for an empty array."""

    def spread(v: Column) -> Column:
        squares = let(
            mean(v),
            lambda centre: F.aggregate(
                v, _zero(), lambda acc, x: acc + (x - centre) * (x - centre)
            ),
        )
        return F.sqrt(squares / F.nullif(F.size(v), F.lit(0)))

    return let(values, spread)


def positive(values: Column) -> Column:
    return F.filter(values, lambda v: v > 0)


def demand_points(values: Column) -> Column:
    """Positive values with their 0-based positions, in order."""
    indexed = F.transform(
        values, lambda v, i: F.struct(i.cast("int").alias("idx"), v.alias("y"))
    )
    return F.filter(indexed, lambda p: p["y"] > 0)


def croston_rate(points: Column, n_months: Column, alpha: float = CROSTON_ALPHA) -> Column:
    """Croston demand rate per month from ordered ``(idx, y)`` demand points.

    Sizes and gaps are smoothed apart. The first gap is the position of the first demand, so it
    may be 0; a smoothed gap of 0 leaves the size alone. With fewer than two points the rate is
    the plain mean over all months.
    """
    keep = 1.0 - alpha

    def step(acc: Column, point: Column) -> Column:
        gap = (point["idx"] - acc["last"]).cast("double")
        return F.struct(
            (F.lit(alpha) * point["y"] + F.lit(keep) * acc["size"]).alias("size"),
            (F.lit(alpha) * gap + F.lit(keep) * acc["gap"]).alias("gap"),
            point["idx"].cast("int").alias("last"),
        )

    def rate(p: Column) -> Column:
        first = F.get(p, F.lit(0))
        start = F.struct(
            F.coalesce(first["y"], _zero()).alias("size"),
            F.coalesce(first["idx"], F.lit(0)).cast("double").alias("gap"),
            F.coalesce(first["idx"], F.lit(0)).cast("int").alias("last"),
        )
        smoothed = F.aggregate(
            F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))),
            start,
            step,
            lambda acc: F.when(
                acc["gap"] > 0, acc["size"] / F.nullif(acc["gap"], F.lit(0.0))
            ).otherwise(acc["size"]),
        )
        plain = total(F.transform(p, lambda d: d["y"])) / n_months
        return F.when(F.size(p) < 2, plain).otherwise(smoothed)

    return let(points, rate)


def decayed_level(values: Column, decay: float = LEVEL_DECAY) -> Column:
    """Weighted mean in which each value weighs ``decay`` times its successor; 0 when empty."""
    folded = F.aggregate(
        values,
        F.struct(_zero().alias("num"), _zero().alias("den")),
        lambda acc, v: F.struct(
            (acc["num"] * decay + v).alias("num"), (acc["den"] * decay + 1.0).alias("den")
        ),
        lambda acc: acc["num"] / F.nullif(acc["den"], F.lit(0.0)),
    )
    return F.greatest(F.coalesce(folded, _zero()), _zero())


def level_spread(values: Column, level: Column) -> Column:
    """Population deviation of the values; half the level when there are fewer than two."""
    return let(values, lambda v: F.when(F.size(v) > 1, pop_std(v)).otherwise(level * 0.5))
