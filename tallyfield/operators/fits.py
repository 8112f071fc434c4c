"""Curve fits, one per site: straight lines in built-ins, the Gompertz curve as a grouped-map function.

A site's monthly panel is bounded by the calendar; a group holds a bounded number of sites, whose fits advance together.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.nulls import not_listed
from tallyfield.operators.joins import spread
from tallyfield.session import materialised

GOMPERTZ_SCHEMA = (
    "site_key bigint, status string, message string, n int, term string, estimate double, std_error double, "
    "statistic double, p_value double, residual_se double"
)
TERMS = ("Asym", "b2", "b3")
BATCH_SITES = 1_024


def linear_fit(df: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    """Least squares y ~ x per group: slope, intercept, r2 and the number of complete pairs."""
    cy, cx = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_slope(cy, cx).alias("slope"),
        F.regr_intercept(cy, cx).alias("intercept"),
        F.regr_r2(cy, cx).alias("r2"),
        F.regr_count(cy, cx).alias("n"),
    )


def standardised(value: str, keys: list[str]) -> Column:
    """Panel value over its group's sample standard deviation."""
    return F.try_divide(F.col(value), F.stddev_samp(value).over(Window.partitionBy(*keys)))


def _two_sided_p(t: float, df: int) -> float:
    """Tail of Student's t: the regularised incomplete beta function, by its continued fraction from the near end."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else math.nan
    a, b, x = df / 2, 0.5, df / (df + t * t)
    flipped = x > (a + 1) / (a + b + 2)
    if flipped:
        a, b, x = b, a, t * t / (df + t * t)
    if x <= 0:
        return 1.0 if flipped else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = value
        for part in (even, odd):
            d, c = 1 / (1 + part * d), 1 + part / c
            value *= c * d
        if abs(value - before) <= 1e-15 * abs(value):
            break
    return 1 - front * value if flipped else front * value


def _relative_offset(normal: np.ndarray, gradient: np.ndarray, loss: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Size of the residual's part in the tangent plane against the part across it: zero at a least-squares fit.

    Site by site; endless where the tangent plane is degenerate.
    """
    scale = np.sqrt(np.maximum(np.einsum("skk->sk", normal), 1e-300))
    c, g = normal / (scale[:, :, None] * scale[:, None, :]), gradient / scale
    p, q, r = c[:, 0, 1], c[:, 0, 2], c[:, 1, 2]
    det = 1 + 2 * p * q * r - p * p - q * q - r * r
    inverse = np.array([[1 - r * r, q * r - p, p * r - q], [q * r - p, 1 - q * q, p * q - r], [p * r - q, p * q - r, 1 - p * p]])
    along = np.einsum("sk,kls,sl->s", g, inverse, g) / det
    spread_ = np.maximum(loss - along, 0) / (n - 3)
    offset = np.sqrt(np.maximum(along, 0) / np.where(spread_ > 1e-24, 3 * spread_, 1.0))
    return np.where((det > 1e-14) & np.isfinite(offset), offset, np.inf)


def _start(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Best of a grid over shape and rate; the height follows from least squares."""
    shape, rate = (g.ravel() for g in np.meshgrid(np.geomspace(0.1, 20, 14), np.geomspace(0.05, 20, 14)))
    curve = np.exp(-shape[:, None] * np.exp(-rate[:, None] * x))
    power = np.maximum((curve**2).sum(axis=1), 1e-300)
    height = (curve @ y) / power
    loss = ((y - height[:, None] * curve) ** 2).sum(axis=1)
    best = int(np.argmin(loss))
    return np.array([height[best], shape[best], rate[best]])


def _curves(theta: np.ndarray, u: np.ndarray, v: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and normal matrix of every site at its parameters; places that are not there count for nothing."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        decay = np.exp(-theta[:, 2:] * u)
        curve = np.exp(-theta[:, 1:2] * decay)
        fitted = theta[:, :1] * curve
        residual = np.where(there, v - fitted, 0.0)
        slopes = (curve * there, -fitted * decay * there, fitted * theta[:, 1:2] * u * decay * there)
    # Places go down the rows, so that the sums of all sites advance together, place by place; one site alone would be summed in another order.
    sites = len(theta)
    across = [np.ascontiguousarray((a if sites > 1 else np.repeat(a, 2, axis=0)).T) for a in (*slopes, residual)]
    gradient, normal = np.empty((sites, 3)), np.empty((sites, 3, 3))
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        for k in range(3):
            gradient[:, k] = np.einsum("ns,ns->s", across[k], across[3])[:sites]
            for m in range(k + 1):
                normal[:, k, m] = normal[:, m, k] = np.einsum("ns,ns->s", across[k], across[m])[:sites]
        return (residual**2).sum(axis=1), gradient, normal


def _slope_offset(theta: np.ndarray, u: np.ndarray, v: np.ndarray) -> float:
    """The relative offset of one site from an orthogonal basis of its tangent plane."""
    decay = np.exp(-theta[2] * u)
    curve = np.exp(-theta[1] * decay)
    fitted = theta[0] * curve
    basis, _ = np.linalg.qr(np.column_stack([curve, -fitted * decay, fitted * theta[1] * u * decay]))
    along = basis.T @ (v - fitted)
    across = v - fitted - basis @ along
    scale = float(across @ across) / (len(u) - 3)
    return float(np.sqrt((along @ along) / (3 * scale if scale > 1e-24 else 1.0)))


def _steps(normal: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of all sites' systems, and which of them have none."""
    try:
        return np.linalg.solve(normal, gradient[:, :, None])[:, :, 0], np.zeros(len(normal), bool)
    except np.linalg.LinAlgError:
        step, singular = np.zeros_like(gradient), np.zeros(len(normal), bool)
        for i in range(len(normal)):
            try:
                step[i] = np.linalg.solve(normal[i], gradient[i])
            except np.linalg.LinAlgError:
                singular[i] = True
        return step, singular


def gompertz_fit_many(series: list[tuple[np.ndarray, np.ndarray]], rounds: int = 5_000) -> list[tuple[np.ndarray, np.ndarray, float] | str]:
    """Estimates, standard errors and residual deviation of Asym * exp(-b2 * b3 ** x) per site, or why there are none.

    All sites advance together, each with its own damping; a site leaves when it is done. The iteration has settled when
    the residual is orthogonal to the tangent plane, or when full steps neither move the estimates nor lower the loss.
    Failures are told apart: no step lowers the loss any more, the gradient is singular (the data fix no curve, as when
    one parameter runs off), or `rounds` steps did not do.
    """
    out: list = [None] * len(series)
    for i, (x, y) in enumerate(series):
        if len(x) < 4 or len(np.unique(x)) < 4:
            out[i] = "too few distinct points"
        elif np.ptp(y) == 0:
            out[i] = "constant response"
    at = np.array([i for i, o in enumerate(out) if o is None], np.int64)
    if not len(at):
        return out
    n = np.array([len(series[i][0]) for i in at])
    there = np.arange(n.max()) < n[:, None]
    u, v = np.zeros(there.shape), np.zeros(there.shape)
    scale_x, scale_y, theta = np.zeros(len(at)), np.zeros(len(at)), np.zeros((len(at), 3))
    for k, i in enumerate(at):
        x, y = series[i]
        scale_x[k], scale_y[k] = np.std(x, ddof=1), np.std(y, ddof=1)
        u[k, : n[k]], v[k, : n[k]] = x / scale_x[k], y / scale_y[k]
        theta[k] = _start(u[k, : n[k]], v[k, : n[k]])
    damping = np.full(len(at), 1e-3)
    loss, gradient, normal = _curves(theta, u, v, there)
    settled: list[tuple] = []
    diagonal = np.arange(3)
    for _ in range(rounds):
        own = normal[:, diagonal, diagonal]
        damped = normal.copy()
        damped[:, diagonal, diagonal] += damping[:, None] * (own + 1e-12)
        step, singular = _steps(damped, gradient)
        moved = theta + step
        next_loss, next_gradient, next_normal = _curves(moved, u, v, there)
        with np.errstate(invalid="ignore"):
            better = np.isfinite(next_loss) & (next_loss <= loss) & ~singular
            # A tiny gain counts as settled only while the step is close to an undamped one.
            small = (np.abs(step) / (np.abs(theta) + 1e-8)).max(axis=1) < 1e-8
            small |= (loss - next_loss <= 1e-10 * loss) & (damping <= 1)
        theta = np.where(better[:, None], moved, theta)
        loss, gradient = np.where(better, next_loss, loss), np.where(better[:, None], next_gradient, gradient)
        normal = np.where(better[:, None, None], next_normal, normal)
        damping = np.where(better, damping / 10, damping * 10)
        with np.errstate(all="ignore"):
            offset = _relative_offset(normal, gradient, loss, n)
        stuck = ~better & (damping > 1e12)
        for k in np.flatnonzero(stuck | (better & np.isinf(offset))):  # by the slopes, as their products lose what is nearly degenerate
            offset[k] = _slope_offset(theta[k], u[k, : n[k]], v[k, : n[k]])
        done = (better & (small | (offset < 1e-6))) | (stuck & (offset < 1e-4))
        failed = (stuck & ~done) | singular
        for k in np.flatnonzero(done):
            settled.append((at[k], theta[k], loss[k], normal[k], n[k], scale_x[k], scale_y[k]))
        for k in np.flatnonzero(failed):
            out[at[k]] = "singular gradient" if singular[k] else "no step lowers the loss"
        if (done | failed).any():
            stay = ~(done | failed)
            at, n, there, u, v, theta, damping, loss = (z[stay] for z in (at, n, there, u, v, theta, damping, loss))
            gradient, normal, scale_x, scale_y = (z[stay] for z in (gradient, normal, scale_x, scale_y))
            if not len(at):
                break
    for i in at:
        out[i] = f"not settled after {rounds} steps"
    for i, p, left, square, m, sx, sy in settled:
        if not np.all(np.isfinite(square)) or np.linalg.cond(square) > 1e14:
            out[i] = "singular gradient"
            continue
        sigma = np.sqrt(left / (m - 3))
        errors = sigma * np.sqrt(np.diag(np.linalg.inv(square)))
        base = np.exp(-p[2] / sx)
        out[i] = np.array([p[0] * sy, p[1], base]), errors * np.array([sy, 1.0, base / sx]), float(sigma * sy)
    return out


def _site_rows(key, n: int, fit: tuple[np.ndarray, np.ndarray, float] | str) -> list[tuple]:
    if isinstance(fit, str):
        return [(key, "failed", fit, n, *[None] * 6)]
    estimates, errors, residual = fit
    with np.errstate(divide="ignore", invalid="ignore"):
        t = estimates / errors
    return [(key, "ok", None, n, term, estimates[i], errors[i], t[i], _two_sided_p(float(t[i]), n - 3), residual) for i, term in enumerate(TERMS)]


_COLUMNS = [part.split()[0] for part in GOMPERTZ_SCHEMA.split(", ")]


def gompertz_fits(
    panel: DataFrame, y: str = "downloads", x: str = "cum_uploads", excluded: Iterable = (), rounds: int = 5_000
) -> DataFrame:
    """One row per site and term; a site whose fit fails keeps one row with the reason.

    `rounds` bounds the steps of one fit; a fit that needs more says so in its message. Sites are dealt into groups of about
    `BATCH_SITES`, whose fits advance together; a group holds that many calendars. It lasts as long as its slowest fit, and the
    steps of the few slow ones cost a group of this size hardly more than a small one. The panel is computed once.
    """
    rows = panel.where(not_listed(F.col("site_key"), excluded)).select(
        F.col("site_key").cast("string").alias("site"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )
    rows = materialised(rows, "fit-points")
    groups = max(1, -(-rows.select("site").distinct().count() // BATCH_SITES))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        keys, sizes, series = [], [], []
        for key, site in group.groupby("site", dropna=False, sort=True):
            points = site[["x", "y"]].to_numpy(float)
            points = points[~np.isnan(points).any(axis=1)]
            keys.append(None if pd.isna(key) else int(key))
            sizes.append(len(points))
            series.append((points[:, 0].copy(), points[:, 1].copy()))
        fits = gompertz_fit_many(series, rounds)
        found = [r for key, n, result in zip(keys, sizes, fits, strict=True) for r in _site_rows(key, n, result)]
        return pd.DataFrame(found, columns=_COLUMNS, dtype=object)

    dealt = rows.withColumn("__group", F.pmod(F.xxhash64("site"), F.lit(groups)).cast("int"))
    return spread(dealt, "__group").groupBy("__group").applyInPandas(fit, GOMPERTZ_SCHEMA)
