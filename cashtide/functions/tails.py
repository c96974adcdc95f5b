"""The chi-square tail, which Spark SQL lacks, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cashtide.functions.folds import let

#: Steps of the series and of the continued fraction: enough for 1e-12 up to a thousand degrees of freedom.
GAMMA_STEPS = 400


def log_gamma_of_half(k: Column) -> Column:
    """ln Gamma(k / 2) for a whole k > 0, by the recursion from Gamma(1) or Gamma(1/2)."""
    start = F.when(k % 2 == 1, F.lit(math.log(math.pi) / 2)).otherwise(F.lit(0.0))
    first = F.when(k % 2 == 1, F.lit(0.5)).otherwise(F.lit(1.0))
    # (k - 1) div 2 factors: 1/2, 3/2, ... or 1, 2, ...
    steps = F.slice(F.sequence(F.lit(0), F.greatest(k, F.lit(1))), F.lit(1), F.floor((k - 1) / 2).cast("int"))
    return F.aggregate(steps, start, lambda total, i: total + F.log(first + i))


def chi_square_tail(q: Column, df: Column) -> Column:
    """P(X > q) for a chi-square with a whole number of degrees of freedom; NULL and NaN give NULL.

    That is the upper incomplete gamma function Q(df / 2, q / 2). Below df / 2 + 1 the power series of its
    complement converges fast, above it the continued fraction, which is worked out from its far end.
    """

    def of(pair: Column) -> Column:
        a, x = pair["a"], pair["x"]
        steps = F.sequence(F.lit(1), F.lit(GAMMA_STEPS))
        scale = F.exp(a * F.log(x) - x - pair["log_gamma"])
        begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

        def add(state: Column, n: Column) -> Column:
            return let(
                state["term"] * x / (a + n),
                lambda term: F.struct(term.alias("term"), (state["sum"] + term).alias("sum")),
            )

        series = F.aggregate(steps, begin, add, lambda state: state["sum"])
        fraction = F.aggregate(F.reverse(steps), F.lit(0.0), lambda rest, n: n * (a - n) / (x + 2 * n + 1 - a + rest))
        return F.when(x < a + 1, 1 - scale * series / a).otherwise(scale / (x + 1 - a + fraction))

    whole = df.cast("int")
    pair = F.struct((whole / 2.0).alias("a"), (q / 2.0).alias("x"), log_gamma_of_half(whole).alias("log_gamma"))
    tail = F.greatest(F.lit(0.0), F.least(F.lit(1.0), let(pair, of)))
    return F.when(q.isNull() | F.isnan(q), F.lit(None)).when(q <= 0, F.lit(1.0)).otherwise(tail)
