"""Shapiro-Wilk by Royston's 1995 approximation, as column expressions over an array."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashtide.functions.folds import let, mean, total
from cashtide.functions.tails import chi_square_tail

# Published polynomial coefficients of the normal quantile, highest power first: numerator and
# denominator for the middle, for the shoulders and for the far tails.
MIDDLE = (
    (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
     1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0),
    (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
     5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0),
)
SHOULDER = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
     3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0),
)
FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)

# Published polynomial coefficients of the outer weights and of the transformations to a normal.
OUTERMOST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0)
SECOND = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0)
SMALL_GAMMA = (0.459, -2.273)
SMALL_MEAN, SMALL_SIGMA = (-0.0006714, 0.025054, -0.39978, 0.5440), (-0.0020322, 0.062767, -0.77857, 1.3822)
LARGE_MEAN, LARGE_SIGMA = (0.0038915, -0.083751, -0.31082, -1.5861), (0.0030302, -0.082676, -0.4803)


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    value = F.lit(coefficients[0])
    for c in coefficients[1:]:
        value = value * x + F.lit(c)
    return value


def normal_quantile(p: Column) -> Column:
    """The point that a standard normal stays below with probability ``p``, 0 < p < 1."""

    def of(x: Column) -> Column:
        q = x - 0.5
        ratio = lambda form, r: polynomial(form[0], r) / polynomial(form[1], r)
        tail = let(
            F.sqrt(-F.log(F.least(x, 1 - x))),
            lambda r: F.when(r <= 5.0, ratio(SHOULDER, r - 1.6)).otherwise(ratio(FAR, r - 5.0)),
        )
        return F.when(F.abs(q) <= 0.425, let(0.180625 - q * q, lambda r: ratio(MIDDLE, r)) * q).otherwise(F.signum(q) * tail)

    return let(p, of)


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal."""
    half = let(z, lambda x: chi_square_tail(x * x, F.lit(1))) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _statistic(x: Column) -> Column:
    """W of sorted values, more than three of them."""
    n = F.size(x)
    scores = F.transform(F.sequence(F.lit(1), n), lambda i: normal_quantile((i - 0.375) / (n + 0.25)))

    def of(s: Column) -> Column:
        def with_sizes(v: Column) -> Column:
            m, square, u, size = s, v["square"], v["u"], v["n"]
            back = lambda values, i: F.element_at(values, -i)
            outermost = polynomial(OUTERMOST, u) + back(m, 1) / F.sqrt(square)
            second = polynomial(SECOND, u) + back(m, 2) / F.sqrt(square)
            more = size > 5
            taken = 2 * back(m, 1) * back(m, 1) + F.when(more, 2 * back(m, 2) * back(m, 2)).otherwise(0.0)
            left = 1 - 2 * outermost * outermost - F.when(more, 2 * second * second).otherwise(0.0)
            spread = lambda i: back(x, i) - F.element_at(x, i)
            every = total(F.zip_with(m, x, lambda a, b: a * b))
            inner = every - back(m, 1) * spread(1) - F.when(more, back(m, 2) * spread(2)).otherwise(0.0)
            dot = inner / F.sqrt((square - taken) / left) + outermost * spread(1) + F.when(more, second * spread(2)).otherwise(0.0)
            return dot * dot

        sizes = F.struct(total(F.transform(s, lambda a: a * a)).alias("square"), (1 / F.sqrt(n)).alias("u"), n.alias("n"))
        return let(sizes, with_sizes)

    around = let(mean(x), lambda centre: total(F.transform(x, lambda v: (v - centre) * (v - centre))))
    return F.least(F.lit(1.0), let(scores, of) / around)


def _of_three(x: Column) -> Column:
    half = (F.get(x, 2) - F.get(x, 0)) * math.sqrt(0.5)
    around = let(mean(x), lambda centre: total(F.transform(x, lambda v: (v - centre) * (v - centre))))
    w = F.least(F.lit(1.0), half * half / around)
    return F.greatest(F.lit(0.0), 6.0 / math.pi * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75))))


def _p_value(w: Column, n: Column) -> Column:
    def of(miss: Column) -> Column:
        size = n.cast("double")
        gamma = polynomial(SMALL_GAMMA, size)
        small = (-F.log(gamma - miss) - polynomial(SMALL_MEAN, size)) / F.exp(polynomial(SMALL_SIGMA, size))
        large = (miss - polynomial(LARGE_MEAN, F.log(size))) / F.exp(polynomial(LARGE_SIGMA, F.log(size)))
        return F.when(n > 11, normal_tail(large)).when(miss >= gamma, F.lit(0.0)).otherwise(normal_tail(small))

    return F.when(w >= 1.0, F.lit(1.0)).otherwise(let(F.log1p(-w), of))


def shapiro_wilk_p(sample: Column) -> Column:
    """p-value of an array; NULL without one, below three values, with a missing value, or without any spread."""

    def of(x: Column) -> Column:
        n = F.size(x)
        usable = (n >= 3) & (F.element_at(x, -1) > F.get(x, 0)) & ~F.exists(x, lambda v: v.isNull())
        many = let(_statistic(x), lambda w: _p_value(w, n))
        return F.when(usable, F.when(n == 3, _of_three(x)).otherwise(many))

    return F.when(F.size(sample) >= 3, let(F.array_sort(sample), of))
