"""Change points of one series' array: exact segmentation with a Gaussian-kernel cost, as folds.

An array holds one value per calendar month. Admissible segment ends form a grid, so the kernel is summed once per
pair of grid cells; then a segment's cost is four look-ups in their prefix sums, and the cheapest segmentation is found
end by end, as in PELT, whose pruning only spares work.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashtide.functions.folds import let, total

#: Scaled squared distances are kept between these before they enter the kernel.
NEAREST, FARTHEST = 1e-2, 1e2


def median_distance(ys: Column) -> Column:
    """Median squared distance of all pairs of values; 1 where there is none or where it is 0."""
    pairs = F.flatten(
        F.transform(
            ys,
            lambda a, i: F.transform(F.slice(ys, i + 2, F.size(ys)), lambda b: (a - b) * (a - b)),
        )
    )

    def middle(d: Column) -> Column:
        n = F.size(d)
        low, high = F.get(d, F.floor((n - 1) / 2).cast("int")), F.get(d, F.floor(n / 2).cast("int"))
        return F.when(n > 0, (low + high) / 2)

    found = let(F.array_sort(pairs), middle)
    return F.when(found > 0, found).otherwise(F.lit(1.0))


def _cumulated(row: Column) -> Column:
    """0 and the running sums of an array."""
    start = F.array(F.lit(0.0))
    return F.aggregate(row, start, lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def _kernel_sums(ys: Column, bounds: Column) -> Column:
    """``sums[u][v]``: the kernel summed over all pairs of values before the bounds u and v."""

    def of_cells(bound: Column) -> Column:
        cells, width = bound["cells"], bound["width"]

        def kernel(a: Column, b: Column) -> Column:
            scaled = F.least(F.greatest((a - b) * (a - b) / width, F.lit(NEAREST)), F.lit(FARTHEST))
            return F.exp(-scaled)

        def pair(one: Column, u: Column, other: Column, v: Column) -> Column:
            met = total(F.transform(one, lambda a: total(F.transform(other, lambda b: kernel(a, b)))))
            # A value with itself counts 1.
            own = F.size(one) * (1 - F.exp(F.lit(-NEAREST)))
            return met + F.when(u == v, own).otherwise(F.lit(0.0))

        rows = F.transform(cells, lambda one, u: _cumulated(F.transform(cells, lambda other, v: pair(one, u, other, v))))
        zeros = F.transform(bound["bounds"], lambda _: F.lit(0.0))
        return F.aggregate(
            rows,
            F.array(zeros),
            lambda acc, row: F.array_append(acc, F.zip_with(F.element_at(acc, -1), row, lambda p, x: p + x)),
        )

    cells = F.transform(
        F.slice(bounds, 1, F.size(bounds) - 1),
        lambda start, u: F.slice(ys, start + 1, F.get(bounds, u + 1) - start),
    )
    return let(F.struct(cells.alias("cells"), bounds.alias("bounds"), median_distance(ys).alias("width")), of_cells)


def _cheapest(bounds: Column, sums: Column, penalty: float, min_size: int) -> Column:
    """For every bound the one its last segment begins at; NULL where no segmentation ends there."""
    at = lambda u, v: F.get(F.get(sums, u), v)

    def tried(state: Column, end: Column) -> Column:
        def from_start(best: Column, start: Column) -> Column:
            months = (F.get(bounds, end) - F.get(bounds, start)).cast("double")
            block = at(end, end) - at(start, end) - at(end, start) + at(start, start)
            cost = best["value"] + months - block / months + penalty
            return F.when(
                best["value"].isNotNull() & (months >= min_size),
                F.struct(cost.alias("value"), start.cast("int").alias("start")),
            )

        nothing = F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("int").alias("start"))
        return F.coalesce(F.array_min(F.array_compact(F.transform(state, from_start))), nothing)

    start = F.array(F.struct(F.lit(0.0).alias("value"), F.lit(None).cast("int").alias("start")))
    ends = F.sequence(F.lit(1), F.size(bounds) - 1)
    found = F.aggregate(ends, start, lambda state, end: F.array_append(state, tried(state, end)))
    return F.transform(found, lambda step: step["start"])


def change_points(ys: Column, penalty: float, min_size: int, jump: int) -> Column:
    """Segment ends of a series, the last one left out, in order. Ends lie on multiples of ``jump`` and at the end."""
    n = F.size(ys)
    grid = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(jump)), lambda k: k), lambda k: (k >= min_size) & (k < n))

    def walk(found: Column) -> Column:
        bounds, starts = found["bounds"], found["starts"]
        begin = F.struct((F.size(bounds) - 1).alias("at"), F.array().cast("array<int>").alias("out"))

        def back(state: Column, _: Column) -> Column:
            before = F.get(starts, state["at"])
            return F.struct(
                F.coalesce(before, F.lit(0)).alias("at"),
                F.when(before > 0, F.array_append(state["out"], F.get(bounds, before))).otherwise(state["out"]).alias("out"),
            )

        return F.aggregate(bounds, begin, back, lambda state: F.reverse(state["out"]))

    def solve(bounds: Column) -> Column:
        starts = let(_kernel_sums(ys, bounds), lambda sums: _cheapest(bounds, sums, penalty, min_size))
        return let(F.struct(bounds.alias("bounds"), starts.alias("starts")), walk)

    return F.when(n > 0, let(F.concat(F.array(F.lit(0)), grid, F.array(n)), solve))
