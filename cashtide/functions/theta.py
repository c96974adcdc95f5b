"""The classical theta method as JVM-side folds over one series' array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashtide.functions.correlation import autocorrelation
from cashtide.functions.folds import let, mean, total

SEASONALITY_Z = 1.645  # Fixed value: 90 % test of the seasonal autocorrelation
COARSE = [round(0.02 + 0.04 * i, 2) for i in range(25)]  # smoothing weights tried first
FINE_STEP, FINE_REACH = 0.005, 4


def is_seasonal(ys: Column, season: int) -> Column:
    """Whether the autocorrelation at the season exceeds its 90 % bound."""
    n = F.size(ys)

    def test(r: Column) -> Column:
        before = F.slice(r, F.lit(1), F.lit(season - 1))
        noise = F.lit(1.0) + total(F.transform(before, lambda v: v * v)) * 2
        return F.abs(F.get(r, F.lit(season - 1))) > F.sqrt(noise / n) * SEASONALITY_Z

    rho = autocorrelation(ys, F.sequence(F.lit(1), F.lit(season)))
    return F.coalesce((n >= 2 * season + 1) & let(rho, test), F.lit(False))


def seasonal_indices(ys: Column, ratio: Column, season: int) -> Column:
    """Mean ratio to (or difference from) the centred yearly average, per calendar position."""
    half = season // 2

    def effect(t: Column) -> Column:
        year = total(F.slice(ys, t - half + 2, F.lit(season - 1)))
        ends = F.get(ys, t - half) + F.get(ys, t + half)
        level = (year + ends * 0.5) / season
        y = F.get(ys, t)
        return F.struct(
            (t % season).alias("slot"),
            F.when(ratio, y / F.when(level == 0, 1.0).otherwise(level))
            .otherwise(y - level)
            .alias("value"),
        )

    last = F.greatest(F.size(ys) - half - 1, F.lit(half))

    def centred(raw: Column) -> Column:
        return let(
            mean(raw),
            lambda m: F.transform(
                raw,
                lambda v: F.when(ratio, v / F.when(m == 0, 1.0).otherwise(m)).otherwise(v - m),
            ),
        )

    def per_slot(effects: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(season - 1)),
            lambda s: mean(
                F.transform(F.filter(effects, lambda e: e["slot"] == s), lambda e: e["value"])
            ),
        )

    effects = F.transform(F.sequence(F.lit(half), last), effect)
    return let(let(effects, per_slot), centred)


def adjusted(ys: Column, season: int) -> Column:
    """Struct of the seasonally adjusted values ``x``, the ``index`` per calendar position, and
    the flags ``ratio`` (all values positive, so indices are ratios) and ``seasonal``."""

    def with_index(flags: Column) -> Column:
        neutral = F.array_repeat(F.when(flags["ratio"], 1.0).otherwise(0.0), season)
        usable = lambda raw: F.transform(
            raw, lambda v: F.when(flags["ratio"] & (v <= 0), 1.0).otherwise(v)
        )
        index = F.when(
            flags["seasonal"], usable(seasonal_indices(ys, flags["ratio"], season))
        ).otherwise(neutral)
        return let(index, lambda i: with_values(flags, i))

    def with_values(flags: Column, index: Column) -> Column:
        at = lambda i: F.get(index, i % season)
        x = F.transform(ys, lambda y, i: F.when(flags["ratio"], y / at(i)).otherwise(y - at(i)))
        return F.struct(
            x.alias("x"),
            index.alias("index"),
            flags["ratio"].alias("ratio"),
            flags["seasonal"].alias("seasonal"),
        )

    flags = F.struct(
        F.forall(ys, lambda y: y > 0).alias("ratio"), is_seasonal(ys, season).alias("seasonal")
    )
    return let(flags, with_index)


def smoothed(x: Column) -> Column:
    """Simple exponential smoothing with the weight of least squared error: ``(sse, alpha, level)``.

    A coarse grid is searched first and then its best weight's surroundings; ties go to the
    smaller weight.
    """
    later = F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))

    def step(acc: Column, v: Column, alpha: Column) -> Column:
        return let(
            v - acc["level"],
            lambda e: F.struct(
                (acc["sse"] + e * e).alias("sse"), (acc["level"] + alpha * e).alias("level")
            ),
        )

    def run(alpha: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("sse"), F.get(x, F.lit(0)).alias("level"))
        return F.aggregate(
            later,
            start,
            lambda acc, v: step(acc, v, alpha),
            lambda acc: F.struct(acc["sse"].alias("sse"), alpha.alias("alpha"), acc["level"].alias("level")),
        )

    best = lambda alphas: F.array_min(F.transform(alphas, run))

    def around(coarse: Column) -> Column:
        moves = F.sequence(F.lit(-FINE_REACH), F.lit(FINE_REACH))
        near = lambda i: F.least(
            F.greatest(coarse["alpha"] + i * F.lit(FINE_STEP), F.lit(0.01)), F.lit(0.99)
        )
        return best(F.transform(moves, near))

    return let(best(F.array(*[F.lit(a) for a in COARSE])), around)


def theta(ys: Column, horizon: int, season: int) -> Column:
    """Struct ``(yhat, se, aicc, spec)``: smoothing of the adjusted values plus half their linear
    trend, with the season put back. NULL for an empty series."""
    n = F.size(ys)

    def fitted(a: Column) -> Column:
        return let(smoothed(a["x"]), lambda s: let(half_slope(a["x"]), lambda b: combined(a, s, b)))

    def half_slope(x: Column) -> Column:
        middle = (n - 1) / 2
        moments = F.transform(
            x,
            lambda v, i: F.struct(
                (v * (i - middle)).alias("xy"), ((i - middle) * (i - middle)).alias("xx")
            ),
        )
        slope = let(
            moments,
            lambda p: total(F.transform(p, lambda q: q["xy"]))
            / F.nullif(total(F.transform(p, lambda q: q["xx"])), F.lit(0.0)),
        )
        return F.coalesce(slope, F.lit(0.0)) * 0.5

    def combined(a: Column, s: Column, b: Column) -> Column:
        alpha = s["alpha"]
        sigma = F.sqrt(s["sse"] / F.greatest(n - 2, F.lit(1)))
        start = (F.lit(1.0) - F.pow(F.lit(1.0) - alpha, n)) / alpha

        def at(step: Column) -> Column:
            ahead = F.get(a["index"], (n + step - 1) % season)
            scale = F.when(a["ratio"], ahead).otherwise(1.0)
            shift = F.when(a["ratio"], 0.0).otherwise(ahead)
            point = s["level"] + b * (step - 1 + start)
            spread = sigma * F.sqrt(F.lit(1.0) + (step - 1) * alpha * alpha)
            return F.struct(
                (point * scale + shift).alias("yhat"), (spread * F.abs(scale)).alias("se")
            )

        error = n * F.log(F.greatest(s["sse"] / n, F.lit(1e-12)))
        return let(
            F.transform(F.sequence(F.lit(1), F.lit(horizon)), at),
            lambda path: F.struct(
                F.transform(path, lambda p: p["yhat"]).alias("yhat"),
                F.transform(path, lambda p: p["se"]).alias("se"),
                F.when(n > 4, error + 6.0 + F.lit(24.0) / F.nullif(n - 4, F.lit(0))).alias("aicc"),
                F.when(a["seasonal"], "Theta(seasonal)").otherwise("Theta").alias("spec"),
            ),
        )

    return F.when(n > 0, let(adjusted(ys, season), fitted))
