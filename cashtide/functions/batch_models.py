"""Iterative estimators as Arrow-batched functions over arrays of monthly values.

Each works on all rows of a batch at once: rows of one length form a matrix and the only Python
loop runs over months or candidate parameters, never over rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

FIT_TYPE = "yhat array<double>, se array<double>, aicc double, spec string"
CHUNK = 64  # rows per matrix: bounds the memory of the parameter grids


def _by_length(series: pd.Series, fit: Callable[[np.ndarray, np.ndarray], list]) -> list:
    """Apply ``fit(matrix, positions)`` to equally long rows; results return to row order."""
    out: list = [None] * len(series)
    lengths = series.map(len).to_numpy()
    for length in np.unique(lengths):
        where = np.flatnonzero(lengths == length)
        for start in range(0, len(where), CHUNK):
            rows = where[start : start + CHUNK]
            matrix = np.stack([np.asarray(series.iloc[r], dtype=float) for r in rows])
            for row, result in zip(rows, fit(matrix, rows), strict=True):
                out[row] = result
    return out


def _aicc(sse: np.ndarray, n: int, k: int) -> np.ndarray:
    penalty = 2.0 * k + 2.0 * k * (k + 1) / max(n - k - 1, 1e-9) if n > k + 1 else np.inf
    return n * np.log(np.maximum(sse / n, 1e-12)) + penalty


# ---- exponential smoothing -------------------------------------------------------------------


def _smooth(y, level, trend, season, p):
    """Additive-error smoothing of rows x candidates; returns final states and squared errors."""
    alpha, beta, gamma, phi = (p[..., i] for i in range(4))
    level, trend = (np.broadcast_to(v[:, None], alpha.shape).copy() for v in (level, trend))
    season = np.broadcast_to(season[:, None, :], (*alpha.shape, season.shape[1])).copy()
    sse, m = np.zeros(alpha.shape), season.shape[2]
    for t in range(y.shape[1]):
        slot = t % m
        error = y[:, t, None] - (level + phi * trend + season[..., slot])
        level = level + phi * trend + alpha * error
        trend = phi * trend + beta * error
        season[..., slot] += gamma * error
        sse += error * error
    return level, trend, season, sse


def _ets_grid(with_trend: bool, damped: bool, with_season: bool) -> np.ndarray:
    alphas = (0.05, 0.2, 0.4, 0.6, 0.8, 0.95)
    shares = (0.05, 0.2, 0.5)
    phis = (0.85, 0.95) if damped else (1.0,) if with_trend else (0.0,)
    return np.array(
        [
            (a, a * b if with_trend else 0.0, (1 - a) * g if with_season else 0.0, phi)
            for a in alphas
            for b in (shares if with_trend else (0.0,))
            for g in (shares if with_season else (0.0,))
            for phi in phis
        ]
    )


def _pick(values: np.ndarray, best: np.ndarray) -> np.ndarray:
    return values[np.arange(len(best)), best]


def _ets_start(y: np.ndarray, m: int, with_trend: bool, with_season: bool):
    """Level, slope and season before the first month, from the first two seasons."""
    rows, n = y.shape
    if n < 2 * m:
        slope = (y[:, -1] - y[:, 0]) / max(n - 1, 1) * with_trend
        return y[:, 0] - slope, slope, np.zeros((rows, 1))
    first = y[:, :m].mean(axis=1)
    slope = (y[:, m : 2 * m].mean(axis=1) - first) / m * with_trend
    season = np.zeros((rows, 1))
    if with_season:
        two = y[:, : 2 * m].reshape(rows, 2, m)
        ramp = slope[:, None] * (np.arange(m) - (m - 1) / 2)
        season = (two - two.mean(axis=2, keepdims=True)).mean(axis=1) - ramp
    return first - slope * (m + 1) / 2, slope, season


def _ets_search(y: np.ndarray, start: tuple, kind: tuple[bool, bool, bool]) -> np.ndarray:
    """Smoothing parameters of every row: a coarse grid, then two searches around its best."""
    with_trend, damped, with_season = kind
    grid = np.repeat(_ets_grid(with_trend, damped, with_season)[None], len(y), axis=0)
    lowest, highest = [0.001, 0.0, 0.0, 0.0], [0.999, 0.999, 0.999, 0.98 if damped else 1.0]
    width = np.array([0.1, 0.08 * with_trend, 0.08 * with_season, 0.04 * damped])
    for _ in range(3):
        best = _pick(grid, _smooth(y, *start, grid)[3].argmin(axis=1))
        moves = np.array(np.meshgrid(*[[-w, 0.0, w] if w else [0.0] for w in width]))
        grid = np.clip(best[:, None, :] + moves.reshape(4, -1).T[None], lowest, highest)
        width = width / 2
    return best


def fit_ets(y: np.ndarray, trend: str, season: str, h: int, m: int) -> list:
    """Additive-error smoothing with trend 'N', 'A' or 'Ad' and season 'N' or 'A'."""
    rows, n = y.shape
    spec = f"ETS(A,{trend},{season})"
    with_trend, damped, with_season = trend != "N", trend == "Ad", season == "A"
    if with_season and n < 2 * m:
        return [(None, None, float("inf"), spec)] * rows
    start = _ets_start(y, m, with_trend, with_season)
    best = _ets_search(y, start, (with_trend, damped, with_season))
    level, slope, seasonal, sse = _smooth(y, *start, best[:, None, :])
    sse, k = sse[:, 0], 3 + 2 * with_trend + damped + with_season * m
    alpha, beta, gamma, phi = (column[:, None] for column in best.T)
    steps = np.arange(1, h + 1)
    damping = np.cumsum(phi**steps, axis=1)
    point = level + damping * slope + seasonal[:, 0][:, (n + steps - 1) % seasonal.shape[2]]
    weight = alpha + beta * damping + gamma * (steps % m == 0)
    grown = 1 + np.cumsum(weight**2, axis=1) - weight**2
    spread = np.sqrt(sse[:, None] / max(n - k, 1) * grown)
    return _results(point, spread, _aicc(sse, n, k), spec)


def _results(point: np.ndarray, spread: np.ndarray, score: np.ndarray, spec: str) -> list:
    return [
        (p.tolist(), s.tolist(), float(a), spec) if np.isfinite(a) else (None, None, float("inf"), spec)
        for p, s, a in zip(point, spread, score, strict=True)
    ]


# ---- ARIMA -----------------------------------------------------------------------------------


def _difference(v: np.ndarray, d: int, sd: int, m: int) -> np.ndarray:
    if sd:
        v = v[:, m:] - v[:, :-m]
    return v[:, 1:] - v[:, :-1] if d else v


def _least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Batched least squares with a tiny ridge, so collinear columns cannot fail."""
    gram = np.einsum("rnk,rnl->rkl", x, x)
    ridge = 1e-9 * np.maximum(np.einsum("rkk->r", gram), 1e-9)
    eye = np.eye(x.shape[2])
    moment = np.einsum("rnk,rn->rk", x, y)
    return np.linalg.solve(gram + ridge[:, None, None] * eye, moment[..., None])[..., 0]


def _lags(v: np.ndarray, count: int, start: int) -> list[np.ndarray]:
    n = v.shape[1]
    return [v[:, start - i : n - i] for i in range(1, count + 1)]


def fit_arima(
    y: np.ndarray, step: np.ndarray, order: tuple[int, int, int, int], h: int, m: int
) -> list:
    """ARIMA(p,d,q)(0,D,0)[m] by the two stages of Hannan and Rissanen, with an optional step
    regressor that stays 1 over the horizon. ``step`` holds the row's 0/1 step column."""
    d, sd, p, q = order
    rows, n = y.shape
    spec = f"ARIMA({p},{d},{q})(0,{sd},0)[{m}]"
    # Every order is scored on the same last months, so that their AICc can be compared.
    long_order = min(6, max(2, n // 8))
    seasonal_fits = n - (m + 1) - long_order - 2 >= 8
    tail = n - (m + 1 if seasonal_fits else 1) - long_order - 2
    w, z = _difference(y, d, sd, m), _difference(step, d, sd, m)
    start = w.shape[1] - tail
    if tail < 8 or start < long_order + 2 or (sd and not seasonal_fits):
        return [(None, None, float("inf"), spec)] * rows
    constant = d + sd <= 1
    first = np.stack([np.ones_like(w[:, long_order:]), *_lags(w, long_order, long_order)], axis=2)
    e = np.zeros_like(w)
    e[:, long_order:] = w[:, long_order:] - np.einsum(
        "rnk,rk->rn", first, _least_squares(first, w[:, long_order:])
    )
    columns = _lags(w, p, start) + _lags(e, q, start)
    if constant:
        columns.append(np.ones((rows, tail)))
    use_step = np.abs(z[:, start:]).sum(axis=1) > 0
    if d + sd == 0:  # a step over the whole sample is the constant
        use_step &= z[:, start:].std(axis=1) > 0
    has_step = bool(use_step.any())
    if has_step:
        columns.append(z[:, start:] * use_step[:, None])
    target = w[:, start:]
    if columns:
        x = np.stack(columns, axis=2)
        beta = _least_squares(x, target)
        residual = target - np.einsum("rnk,rk->rn", x, beta)
    else:
        beta, residual = np.zeros((rows, 0)), target
    sse = (residual**2).sum(axis=1)
    k = p + q + constant + 1
    score = _aicc(sse, tail, k) + 2.0 * use_step
    phi, theta = beta[:, :p], beta[:, p : p + q]
    stable = _inside_triangle(phi) & _inside_triangle(-theta)
    score = np.where(stable, score, np.inf)
    shift = beta[:, p + q] if constant else np.zeros(rows)
    step_effect = beta[:, p + q + constant] * use_step if has_step else np.zeros(rows)
    ahead_step = 1.0 if d + sd == 0 else 0.0
    e[:, start:] = residual
    w_all, e_all, y_all = list(w.T[-2:]), list(e.T[-2:]), list(y.T)
    for _ in range(h):
        nxt = shift + step_effect * ahead_step
        nxt = nxt + sum(phi[:, i] * w_all[-1 - i] for i in range(p))
        nxt = nxt + sum(theta[:, i] * e_all[-1 - i] for i in range(q))
        w_all.append(nxt)
        e_all.append(np.zeros(rows))
        value = nxt.copy()
        if d:
            value += y_all[-1]
        if sd:
            value += y_all[-m] - (y_all[-m - 1] if d else 0.0)
        y_all.append(value)
    point = np.stack(y_all[n:], axis=1)
    # Psi weights of the model written as one autoregression.
    poly = np.concatenate([np.ones((rows, 1)), -phi], axis=1)
    if d:
        poly = _times(poly, np.array([1.0, -1.0]))
    if sd:
        poly = _times(poly, np.r_[1.0, np.zeros(m - 1), -1.0])
    psi = np.zeros((rows, h))
    for j in range(h):
        psi[:, j] = 1.0 if j == 0 else theta[:, j - 1] if j <= q else 0.0
        for i in range(1, min(j, poly.shape[1] - 1) + 1):
            psi[:, j] -= poly[:, i] * psi[:, j - i]
    sigma2 = sse / max(tail - k, 1)
    spread = np.sqrt(sigma2[:, None] * np.cumsum(psi**2, axis=1))
    return _results(point, spread, score, spec)


def _inside_triangle(c: np.ndarray) -> np.ndarray:
    """Stationarity of an autoregression of order 0 to 2."""
    if c.shape[1] == 0:
        return np.ones(len(c), dtype=bool)
    if c.shape[1] == 1:
        return np.abs(c[:, 0]) < 0.99
    a, b = c[:, 0], c[:, 1]
    return (np.abs(b) < 0.99) & (a + b < 0.99) & (b - a < 0.99)


def _times(poly: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return np.stack([np.convolve(row, factor) for row in poly])


# ---- decomposition and breaks ----------------------------------------------------------------


def _loess_kernel(n: int, at: np.ndarray, span: int) -> np.ndarray:
    """Tricube weights of ``n`` equally spaced points around every position in ``at``."""
    x = np.arange(n, dtype=float)
    distance = np.abs(at[:, None] - x[None])
    reach = np.sort(distance, axis=1)[:, min(span, n) - 1] + max(span - n, 0) // 2
    u = distance / np.maximum(reach, 1e-12)[:, None]
    weight = np.where(u <= 0.999, (1 - np.minimum(u, 1.0) ** 3) ** 3, 0.0)
    return np.where(u <= 0.001, 1.0, weight)


def _loess(y: np.ndarray, robust: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Local linear regression of every row at the positions ``at``."""
    n = y.shape[1]
    kernel = _loess_kernel(n, at, span)
    x = np.arange(n, dtype=float)
    s0, s1, s2 = (robust * x**i @ kernel.T for i in (0, 1, 2))
    t0, t1 = (robust * y * x**i @ kernel.T for i in (0, 1))
    s0 = np.maximum(s0, 1e-300)
    mean = s1 / s0
    var = s2 / s0 - mean**2
    flat = t0 / s0
    slope = np.where(var > (0.001 * (n - 1)) ** 2, (t1 / s0 - mean * flat) / np.where(var > 0, var, 1), 0.0)
    return flat + slope * (at[None] - mean)


def _moving_average(v: np.ndarray, width: int) -> np.ndarray:
    total = np.cumsum(np.pad(v, ((0, 0), (1, 0))), axis=1)
    return (total[:, width:] - total[:, :-width]) / width


def decompose(
    y: np.ndarray, m: int, seasonal: int, trend_span: int, inner: int, outer: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Robust STL of equally long rows: trend, seasonal and remainder."""
    rows, n = y.shape
    low_span = m + 1 if m % 2 == 0 else m + 2
    robust, trend = np.ones_like(y), np.zeros_like(y)
    season = np.zeros_like(y)
    everywhere = np.arange(n, dtype=float)
    for _ in range(outer + 1):
        for _ in range(inner):
            detrended = y - trend
            cycle = np.zeros((rows, n + 2 * m))
            for s in range(m):
                part, weight = detrended[:, s::m], robust[:, s::m]
                at = np.arange(-1, part.shape[1] + 1, dtype=float)
                smooth = _loess(part, weight, at, seasonal)
                slots = s + m * np.arange(len(at))
                cycle[:, slots] = smooth
            low = _moving_average(_moving_average(_moving_average(cycle, m), m), 3)
            low = _loess(low, np.ones_like(low), everywhere, low_span)
            season = cycle[:, m : m + n] - low
            trend = _loess(y - season, robust, everywhere, trend_span)
        remainder = y - season - trend
        size = np.abs(remainder)
        h = 6.0 * np.median(size, axis=1, keepdims=True)
        u = size / np.maximum(h, 1e-300)
        robust = np.where(u <= 0.999, (1 - np.minimum(u, 1.0) ** 2) ** 2, 0.0)
        robust = np.where(u <= 0.001, 1.0, robust)
    return trend, season, y - season - trend


# ---- Arrow-batched functions -----------------------------------------------------------------


def _frame(fits: list) -> pd.DataFrame:
    return pd.DataFrame(fits, columns=["yhat", "se", "aicc", "spec"])


def _by_candidate(ys: pd.Series, candidates: pd.DataFrame, fit: Callable) -> pd.DataFrame:
    """Fit every row with its own candidate: ``fit(matrix, candidate, positions)``."""
    out: list = [None] * len(ys)
    for candidate, rows in candidates.groupby(list(candidates.columns)).indices.items():
        fits = _by_length(ys.iloc[rows], lambda y, at: fit(y, candidate, rows[at]))
        for row, result in zip(rows, fits, strict=True):
            out[row] = result
    return _frame(out)


def ets_udf(horizon: int, m: int):
    """Arguments: values, trend and season of one candidate."""

    @F.pandas_udf(FIT_TYPE)
    def ets(ys: pd.Series, trend: pd.Series, season: pd.Series) -> pd.DataFrame:
        return _by_candidate(
            ys,
            pd.DataFrame({"trend": trend, "season": season}),
            lambda y, kind, _: fit_ets(y, *kind, horizon, m),
        )

    return ets


def arima_udf(horizon: int, m: int):
    """Arguments: values, position of the step (NULL for none), d, D, p, q of one candidate."""

    @F.pandas_udf(FIT_TYPE)
    def arima(
        ys: pd.Series, step_at: pd.Series, d: pd.Series, sd: pd.Series, p: pd.Series, q: pd.Series
    ) -> pd.DataFrame:
        where_step = step_at.to_numpy(dtype=float, na_value=np.nan)

        def fit(y: np.ndarray, order: tuple, rows: np.ndarray) -> list:
            at = where_step[rows]
            at = np.where(np.isnan(at), y.shape[1], at)
            step = (np.arange(y.shape[1])[None] >= at[:, None]).astype(float)
            return fit_arima(y, step, order, horizon, m)

        return _by_candidate(ys, pd.DataFrame({"d": d, "sd": sd, "p": p, "q": q}), fit)

    return arima


def stl_udf(season: int, seasonal_span: int, trend_span: int, inner: int, outer: int):
    @F.pandas_udf("trend array<double>, seasonal array<double>, remainder array<double>")
    def stl(ys: pd.Series) -> pd.DataFrame:
        def fit(y: np.ndarray, _: np.ndarray) -> list:
            if y.shape[1] < 2 * season:
                return [(None, None, None)] * len(y)
            parts = decompose(y, season, seasonal_span, trend_span, inner, outer)
            return [tuple(part[r].tolist() for part in parts) for r in range(len(y))]

        return pd.DataFrame(_by_length(ys, fit), columns=["trend", "seasonal", "remainder"])

    return stl
