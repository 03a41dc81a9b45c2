"""Maximum-likelihood fits of response-time distributions.

Four families need nothing but means that combine before a shuffle. The others are fitted on the weighted points of a
cell: means and counts of narrow bins that are equal on the scale asinh((x - median) / interquartile range), so they are
fine where the data are and grow with the distance in the tails. The extremes are points of their own. An outlier, however
far, adds one point and moves no other; the number of points grows with the logarithm of the spread, not with the number
of trials; cells of all sizes are treated alike.

The fit to the points is only a start. In each of ROUNDS Newton rounds all cells advance together: the gradient of the
log-likelihood is summed over all trials by one aggregation, and the points give the curvature. What is left of the points'
error shrinks by about their relative error in each round, so the result is the maximum over the single trials. Where that
error is large, as beside a bound of the values, further rounds follow until nothing moves.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import materialise
from . import special as S
from .stats import Shape, beside, fresh, name

#: Bins for each interquartile range around the median, and the accuracy of the quartiles' sketch.
STEPS, ACCURACY = 1024, 2000
#: Smallest density that a value contributes to the likelihood of a family in FLOORED, whose densities can run out of digits.
FLOOR, FLOORED = 1e-10, ("Ex-Gaussian (μ, σ, τ)", "Ex-Wald (m, a, τ)")
#: Newton rounds over the trials, the step of the differences that stand for derivatives, and the farthest that a coordinate moves in a round.
ROUNDS, H, FARTHEST = 2, 1e-3, 0.5
#: Further rounds while a coordinate of any cell moves by more than SETTLED, and rounds at most.
SETTLED, MOST_ROUNDS = 1e-9, 8


def simplex(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.25, rounds: int = 600, tolerance: float = 1e-10) -> np.ndarray:
    """Minimum of f by the downhill simplex."""
    n = len(start)
    points = np.vstack([start, start + step * np.eye(n)])
    values = np.array([f(p) for p in points])
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = points[order], values[order]
        if values[-1] - values[0] <= tolerance * (abs(values[0]) + tolerance):
            break
        centre = points[:-1].mean(axis=0)

        def attempt(k: float, centre=centre, worst=points[-1]) -> tuple[np.ndarray, float]:
            p = centre + k * (centre - worst)
            return p, f(p)

        p, v = attempt(1.0)
        if v < values[0]:
            q, w = attempt(2.0)
            p, v = (q, w) if w < v else (p, v)
        elif v >= values[-2]:
            q, w = attempt(0.5 if v < values[-1] else -0.5)
            if w < min(v, values[-1]):
                p, v = q, w
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
                continue
        points[-1], values[-1] = p, v
    return points[int(np.argmin(values))]


def narrow(f: Callable[[float], float], low: float, high: float, grid: int = 60) -> float:
    """Minimum of f between low and high: a grid, then golden sections around its best inner point."""
    at = np.linspace(low, high, grid)
    values = [f(v) for v in at]
    i = int(np.argmin(values))
    a, b = at[max(0, i - 1)], at[min(grid - 1, i + 1)]
    g = (math.sqrt(5) - 1) / 2
    x, y = b - g * (b - a), a + g * (b - a)
    fx, fy = f(x), f(y)
    for _ in range(60):
        if fx < fy:
            b, y, fy = y, x, fx
            x = b - g * (b - a)
            fx = f(x)
        else:
            a, x, fx = x, y, fy
            y = a + g * (b - a)
            fy = f(y)
    return (a + b) / 2


def _loss(logs: np.ndarray, w: np.ndarray) -> float:
    return -float((np.maximum(np.nan_to_num(logs, nan=-1e9), math.log(FLOOR)) * w).sum())


def gamma_shape(s: np.ndarray) -> np.ndarray:
    """Shape from s = ln(mean) - mean(ln), by Newton steps."""
    s = np.maximum(np.asarray(s, dtype=float), 1e-12)
    k = (3 - s + np.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(30):
        k = np.maximum(k - (np.log(k) - S.digamma(k) - s) / (1 / k - S.trigamma(k)), 1e-8)
    return k


def fit_weibull(x: np.ndarray, w: np.ndarray) -> list[float]:
    """Shape as the root of its profile equation, scale from it."""
    x, w = x[x > 0], w[x > 0]
    logs, mean = np.log(x), np.average(np.log(x), weights=w)
    spread = math.sqrt(np.average((logs - mean) ** 2, weights=w))
    if spread == 0:
        return [math.inf, float(x[0])]
    k, top = 1.2 / spread, logs.max()
    for _ in range(100):
        p = w * np.exp(k * (logs - top))
        a, b, c = p.sum(), (p * logs).sum(), (p * logs * logs).sum()
        step = (b / a - 1 / k - mean) / ((c * a - b * b) / (a * a) + 1 / (k * k))
        k = max(k - step, k / 2)
        if abs(step) < 1e-12 * k:
            break
    return [k, float(math.exp(top + math.log(np.average(np.exp(k * (logs - top)), weights=w)) / k))]


def wald_from_means(mean, inverse):
    """(m, a) from the means of x and 1/x."""
    shape = 1 / (inverse - 1 / mean)
    return np.sqrt(shape) / mean, np.sqrt(shape)


def _shifted(x: np.ndarray, w: np.ndarray, low: float) -> tuple[float, float, float]:
    """(shape, mean, shift) of a shifted inverse Gaussian: a profile over the shift, closed form inside."""
    least, spread = float(x.min()), float(x.max() - x.min())

    def loss(s: float) -> float:
        y = x - s
        mean, inverse = np.average(y, weights=w), np.average(1 / y, weights=w)
        shape = 1 / max(inverse - 1 / mean, 1e-12)
        return -float((w * (0.5 * np.log(shape / (2 * np.pi * y**3)) - shape * (y - mean) ** 2 / (2 * mean * mean * y))).sum())

    s = narrow(loss, low, least - max(1e-6 * spread, 1e-9 * abs(least), 1e-12))
    y = x - s
    mean, inverse = np.average(y, weights=w), np.average(1 / y, weights=w)
    return 1 / max(inverse - 1 / mean, 1e-12), float(mean), s


def fit_shifted_wald(x: np.ndarray, w: np.ndarray) -> list[float]:
    shape, mean, s = _shifted(x, w, float(x.min() - 2 * (x.max() - x.min())))
    return [math.sqrt(shape) / mean, math.sqrt(shape), s]


def fit_shifted_invgauss(x: np.ndarray, w: np.ndarray) -> list[float]:
    """Shape comes first and is called μ, the mean second and called λ; the shift is not below zero.

    If the least value is zero so is the shift, and the shape, as the inverse of a zero has no bound.
    """
    if x.min() == 0:
        return [0.0, float(np.average(x, weights=w)), 0.0]
    return list(_shifted(x, w, 0.0))


def _moments(x: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    mean = float(np.average(x, weights=w))
    return mean, float(np.average((x - mean) ** 2, weights=w)), float(np.average((x - mean) ** 3, weights=w))


def fit_exgauss(x: np.ndarray, w: np.ndarray) -> list[float]:
    """From starts around the median, whose scale outliers don't stretch, and one from moments."""
    order = np.argsort(x)
    centre, unit = float(x[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)]), _spread(x, w)
    mean, var, third = _moments(x, w)
    starts = [(centre - 0.7 * t * unit, unit * math.sqrt(1 - t * t), t * unit) for t in (0.8, 0.4, 0.1)]
    guess = (third / 2) ** (1 / 3) if third > 0 else math.nan
    if 0 < guess < math.sqrt(var):
        starts.append((mean - guess, math.sqrt(var - guess * guess), guess))

    def loss(p: np.ndarray) -> float:
        sigma, tau = np.exp(np.clip(p[1:], -30, 30)) * unit
        return _loss(S.exgauss_logpdf(x, centre + p[0] * unit, sigma, tau), w)

    # Every start is tried briefly; the best is followed to its end.
    tried = [simplex(loss, np.array([(m - centre) / unit, math.log(s / unit), math.log(t / unit)]), rounds=60, tolerance=1e-7) for m, s, t in starts]
    best = simplex(loss, simplex(loss, min(tried, key=loss)), step=0.05)
    return [centre + float(best[0]) * unit, float(np.exp(best[1]) * unit), float(np.exp(best[2]) * unit)]


def fit_exwald(x: np.ndarray, w: np.ndarray) -> list[float]:
    keep = x > 0
    x, w = x[keep], w[keep]
    mean, var, _ = _moments(x, w)
    sd = math.sqrt(var) or 1e-9

    def loss(p: np.ndarray) -> float:
        m, a, tau = np.exp(np.clip(p, -30, 30))
        with np.errstate(all="ignore"):
            return _loss(np.log(S.exwald_pdf(x, m, a, tau)), w)

    starts = []
    for share in (0.5, 0.2, 0.8):
        t = share * min(sd, mean)
        m = math.sqrt((mean - t) / max(var - t * t, 1e-12))
        starts.append(np.log([m, m * (mean - t), t]))
    best = min((simplex(loss, s, rounds=60, tolerance=1e-7) for s in starts), key=loss)
    return np.exp(simplex(loss, simplex(loss, best), step=0.05)).tolist()


#: Families that need the weighted values, by operation.
ITERATIVE: dict[str, Callable[[np.ndarray, np.ndarray], list[float]]] = {
    "Weibull (k, θ)": fit_weibull,
    "Ex-Wald (m, a, τ)": fit_exwald,
    "Shifted Wald (m, a, shift)": fit_shifted_wald,
    "Ex-Gaussian (μ, σ, τ)": fit_exgauss,
    "Shifted Inv-Gaussian (μ, λ, shift)": fit_shifted_invgauss,
}


def _invgauss_logpdf(x: np.ndarray, shape: float, mean: float, shift: float = 0.0) -> np.ndarray:
    y = np.where(x > shift, x - shift, np.nan)
    return 0.5 * np.log(shape / (2 * np.pi * y**3)) - shape * (y - mean) ** 2 / (2 * mean * mean * y)


#: Log density and distribution function of each family, by its parameters in order.
DENSITIES: dict[str, tuple[Callable, Callable]] = {
    "Gamma (k, θ)": (lambda x, k, t: (k - 1) * np.log(x / t) - x / t - math.lgamma(k) - math.log(t), S.gamma_cdf),
    "Weibull (k, θ)": (lambda x, k, t: math.log(k / t) + (k - 1) * np.log(x / t) - (x / t) ** k, S.weibull_cdf),
    "LogNormal (k, θ)": (lambda x, k, t: -np.log(x * k * math.sqrt(2 * math.pi)) - (np.log(x / t) / k) ** 2 / 2, S.lognormal_cdf),
    "Wald (m, a)": (S.wald_logpdf, S.wald_cdf),
    "Ex-Wald (m, a, τ)": (lambda x, m, a, t: np.log(S.exwald_pdf(x, m, a, t)), S.exwald_cdf),
    "Shifted Wald (m, a, shift)": (lambda x, m, a, s: S.wald_logpdf(np.where(x > s, x - s, np.nan), m, a), lambda x, m, a, s: S.wald_cdf(x - s, m, a)),
    "Ex-Gaussian (μ, σ, τ)": (S.exgauss_logpdf, S.exgauss_cdf),
    "Inv-Gaussian (μ, λ)": (_invgauss_logpdf, S.invgauss_cdf),
    "Shifted Inv-Gaussian (μ, λ, shift)": (_invgauss_logpdf, S.invgauss_cdf),
}


#: How each parameter is written without constraints: log of a positive one, a location in units of the spread, log of the distance of a shift from the least value.
COORDINATES: dict[str, tuple[str, ...]] = {
    op: tuple("under" if "shift" in op and i == 2 else "free" if op.startswith("Ex-Gaussian") and i == 0 else "log" for i in range(op.count(",") + 1)) for op in DENSITIES
}
Bounds = tuple[float, float] | None


def logs(op: str, x: np.ndarray, params: list[float], bounds: Bounds) -> np.ndarray:
    """Log-likelihood of each value; between bounds that of data which were only seen there."""
    logpdf, cdf = DENSITIES[op]
    with np.errstate(all="ignore"):
        out = np.nan_to_num(np.asarray(logpdf(x, *params), dtype=float), nan=-1e9, neginf=-1e9)
        if op in FLOORED:
            out = np.maximum(out, math.log(FLOOR))
        if bounds is not None:
            low, high = (0.0 if math.isinf(b) and b < 0 else 1.0 if math.isinf(b) else float(np.asarray(cdf(np.array([b], dtype=float), *params))[0]) for b in bounds)
            out = out - math.log(max(high - low, FLOOR))
    return out


class Scale:
    """Parameters of a family without constraints, and derivatives by them. least: below it a shift lies; unit: the spread."""

    def __init__(self, op: str, bounds: Bounds, least: float, most: float, unit: float):
        self.op, self.bounds, self.least, self.unit = op, bounds, least, unit
        self.kinds = COORDINATES[op]
        # How far below the least value a shift may lie.
        self.lowest = 0.0 if op.startswith("Shifted Inv") else least - 2 * (most - least)
        # A shift without a place to go; nothing moves then.
        self.stuck = "under" in self.kinds and least == self.lowest == 0

    def found(self, u: np.ndarray) -> list[float]:
        """The parameters, exact where they lie at an end."""
        got = self.back(u)
        if self.stuck:
            return [0.0, got[1], 0.0]
        return [max(v, self.lowest) if k == "under" else v for k, v in zip(self.kinds, got, strict=True)]

    def back(self, u: np.ndarray) -> list[float]:
        made = {"log": lambda v: math.exp(min(max(v, -300), 300)), "free": lambda v: v * self.unit, "under": lambda v: self.least - math.exp(min(v, 300))}
        return [float(made[k](v)) for k, v in zip(self.kinds, u, strict=True)]

    def forth(self, params: list[float]) -> np.ndarray:
        made = {"log": lambda v: -300.0 if self.stuck and v == 0 else math.log(v), "free": lambda v: v / self.unit, "under": lambda v: math.log(max(self.least - v, 1e-12 * self.unit))}
        return np.array([made[k](v) for k, v in zip(self.kinds, params, strict=True)])

    def scores(self, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        """(values, coordinates): derivatives of each value's log-likelihood, exact but for terms of the order H^4."""
        out = np.empty((len(x), len(u)))
        for j in range(len(u)):
            each = [c * logs(self.op, x, self.back(u + m * H * (np.arange(len(u)) == j)), self.bounds) for m, c in ((1, 8), (-1, -8), (2, -1), (-2, 1))]
            out[:, j] = sum(each) / (12 * H)
        return out

    def curvature(self, x: np.ndarray, w: np.ndarray, u: np.ndarray) -> np.ndarray:
        at = lambda j, m: w @ self.scores(x, u + m * H * (np.arange(len(u)) == j))
        rows = np.array([(at(j, 1) - at(j, -1)) / (2 * H) for j in range(len(u))])
        return (rows + rows.T) / 2

    def step(self, x: np.ndarray, w: np.ndarray, u: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        """One Newton step from the gradient over all trials; what would push a shift beyond its lowest place keeps it there."""
        if self.stuck:
            return u
        bend = self.curvature(x, w, u)
        if not (np.isfinite(bend).all() and np.isfinite(gradient).all()):
            return u
        values, vectors = np.linalg.eigh(bend)
        values = -np.maximum(np.abs(values), 1e-12 * np.abs(values).max(initial=1e-300))  # uphill whatever the curvature's sign
        full = -(vectors @ ((vectors.T @ gradient) / values))
        if "under" in self.kinds:
            j, end = self.kinds.index("under"), math.log(max(self.least - self.lowest, 1e-12 * self.unit))
            if u[j] + full[j] >= end:
                rest = [i for i in range(len(u)) if i != j]
                inner = (vectors * values) @ vectors.T
                full[j] = end - u[j]
                full[rest] = -np.linalg.solve(inner[np.ix_(rest, rest)], gradient[rest] + inner[rest, j] * full[j])
        return u + full * min(1.0, FARTHEST / max(np.abs(full).max(), 1e-300))


    def top(self, x: np.ndarray, w: np.ndarray, u: np.ndarray, turns: int = 60) -> np.ndarray:
        """The maximum over weighted points near u, by Newton steps that are shortened where they would lose."""
        value = w @ logs(self.op, x, self.back(u), self.bounds)
        for _ in range(turns):
            move = self.step(x, w, u, w @ self.scores(x, u)) - u
            for part in (1.0, 0.25, 0.05):
                new = w @ logs(self.op, x, self.back(u + part * move), self.bounds)
                if new > value:
                    break
            else:
                break
            u, value = u + part * move, new
            if np.abs(move).max() < 1e-9:
                break
        return u


def bounded_loss(op: str, params: list[float], x: np.ndarray, w: np.ndarray, bounds: tuple[float, float]) -> float:
    """Negative log-likelihood of data that were only seen between bounds."""
    if x.min() < bounds[0] or x.max() > bounds[1]:
        raise ValueError(f"data beyond the bounds {bounds}")
    return -float(w @ logs(op, x, params, bounds))


def fit_bounded(op: str, x: np.ndarray, w: np.ndarray, bounds: tuple[float, float], start: list[float] | None = None) -> list[float]:
    """Maximum of the bounded likelihood over weighted points, from the unbounded fit; all parameters but locations stay above zero."""
    scale = Scale(op, bounds, float(x.min()), float(x.max()), _spread(x, w))
    loss = lambda u: bounded_loss(op, scale.back(u), x, w, bounds)
    best = scale.forth(start or fit_points(op, x, w))
    for step in (0.3, 0.1, 0.03):
        best = simplex(loss, best, step)
    return scale.back(best)


def _spread(x: np.ndarray, w: np.ndarray) -> float:
    """A unit that outliers don't stretch: from the quartiles, or the standard deviation where these are equal."""
    order = np.argsort(x)
    share = np.cumsum(w[order]) / w.sum()
    low, high = x[order][np.searchsorted(share, [0.25, 0.75])]
    return float(high - low) / 1.35 or math.sqrt(_moments(x, w)[1]) or 1.0


def fit_points(op: str, x: np.ndarray, w: np.ndarray) -> list[float]:
    """Unbounded fit of any family to weighted points."""
    if op in ITERATIVE:
        return ITERATIVE[op](x, w)
    w, x = w[x > 0], x[x > 0]
    mean, log_mean, inverse = (float(np.average(v, weights=w)) for v in (x, np.log(x), 1 / x))
    if op == "LogNormal (k, θ)":
        return [math.sqrt(np.average((np.log(x) - log_mean) ** 2, weights=w)), math.exp(log_mean)]
    if op == "Gamma (k, θ)":
        k = float(gamma_shape(np.array([math.log(mean) - log_mean]))[0])
        return [k, mean / k]
    shape = 1 / (inverse - 1 / mean)
    return [shape, mean] if op == "Inv-Gaussian (μ, λ)" else [math.sqrt(shape) / mean, math.sqrt(shape)]


def from_means(op: str, x: Column) -> Column:
    """array<double> of parameters from means; the shape of the gamma still wants gamma_parameters()."""
    x = F.when(x > 0, x)  # what these families can yield
    logs = F.ln(x)
    inverse = 1 / (F.avg(1 / x) - 1 / F.avg(x))
    if op == "LogNormal (k, θ)":
        return F.array(F.stddev_pop(logs), F.exp(F.avg(logs)))
    if op == "Wald (m, a)":
        return F.array(F.sqrt(inverse) / F.avg(x), F.sqrt(inverse))
    if op == "Inv-Gaussian (μ, λ)":
        return F.array(inverse, F.avg(x))  # the shape is called μ, the mean λ
    if op == "Gamma (k, θ)":
        return F.array(F.ln(F.avg(x)) - F.avg(logs), F.avg(x))
    raise ValueError(op)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def gamma_parameters(means: pd.Series) -> pd.Series:
    """(ln mean - mean ln, mean) -> (shape, scale)."""
    at = np.array([[np.nan, np.nan] if v is None else [np.nan if k is None else k for k in v] for v in means], dtype=float).reshape(-1, 2)
    good = np.nan_to_num(at[:, 0]) > 0
    k = gamma_shape(np.where(good, at[:, 0], 1.0))
    return pd.Series([[a, b] if g else None for a, b, g in zip(k, at[:, 1] / k, good, strict=True)])


def weighted_values(df: DataFrame, keys: list[str], value: str, steps: int = STEPS, known_as: Shape | None = None) -> DataFrame:
    """keys, points: the weighted points (x, w) of each cell in order.

    One aggregation finds quartiles and extremes, a second one the bins; both combine before their shuffle.
    """
    given = df.filter(name(value).isNotNull() & ~name(value).isin(float("inf"), float("-inf")))
    x, low, high, q, place = fresh(df, "x", "low", "high", "quartiles", "place")
    given = given.select(*map(name, keys), name(value).alias(x))
    aggregates = F.min(x).alias(low), F.max(x).alias(high), F.percentile_approx(x, [0.25, 0.5, 0.75], ACCURACY).alias(q)
    if keys:
        sized = beside(given, given.groupBy(*map(name, keys)).agg(*aggregates), keys, known_as)
    else:
        # Over no keys the statistics of the table are one row, read as a scalar.
        one = given.agg(*aggregates).agg(F.struct(*(F.first(c).alias(c) for c in (low, high, q))).alias("s")).scalar()
        sized = given.withColumn("s", one).select(x, "s.*")
    width = F.coalesce(F.nullif(F.col(q)[2] - F.col(q)[0], F.lit(0.0)), F.nullif(F.col(high) - F.col(low), F.lit(0.0)), F.lit(1.0))
    bin_ = F.floor(F.asinh((F.col(x) - F.col(q)[1]) / width) * steps).cast("double")
    own = F.when(F.col(x) == F.col(low), float("-inf")).when(F.col(x) == F.col(high), float("inf")).otherwise(bin_)
    binned = sized.groupBy(*map(name, keys), own.alias(place)).agg(F.avg(x).alias(x), F.count(F.lit(1)).cast("double").alias("w"))
    return binned.groupBy(*map(name, keys)).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), "w"))).alias("points"))


def _positive(op: str) -> bool:
    return op not in ("Ex-Gaussian (μ, σ, τ)", "Shifted Wald (m, a, shift)", "Shifted Inv-Gaussian (μ, λ, shift)")


def fit_cells(df: DataFrame, keys: list[str], value: str, ops: list[str | tuple[str, Bounds]], steps: int = STEPS, rounds: int = ROUNDS, known_as: Shape | None = None, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """keys and, for each family of ops, in this order, an array<double> of its parameters; a family that cannot be fitted gives null.

    An op is the name of a family or (name, bounds) for data that were only seen between bounds; values beyond them are an
    error. Families of positive values see only these. rounds: Newton rounds over all trials after the fit to the
    points; 0 leaves it at that. More follow until no cell moves, most_rounds in all at most.
    """
    wanted: list[tuple[str, Bounds]] = [op if isinstance(op, tuple) else (op, None) for op in ops]
    sizes = [len(COORDINATES[op]) for op, _ in wanted]
    ends = np.cumsum([0, *sizes])
    all_, *out_ = fresh(df.select(*map(name, keys)), "fits", *(f"fit{i}" for i in range(len(ops))))
    u, x_, least, most, unit, cell, sums, before = fresh(df.select(*map(name, keys)), "u", "x", "least", "most", "unit", "cell", "sums", "before")

    def scales(least: float, most: float, unit: float) -> list[Scale]:
        return [Scale(op, bounds, least, most, unit) for op, bounds in wanted]

    @F.pandas_udf("struct<u array<double>,least double,most double,unit double>")
    def started(points_x: pd.Series, points_w: pd.Series) -> pd.DataFrame:
        out = []
        for xs, ws in zip(points_x, points_w, strict=True):
            x, w = np.asarray(xs, dtype=float), np.asarray(ws, dtype=float)
            unit, row = _spread(x, w), []
            for (op, bounds), size in zip(wanted, sizes, strict=True):
                try:
                    if bounds is not None and (x.min() < bounds[0] or x.max() > bounds[1]):
                        raise IndexError(f"{op}: data beyond the bounds {bounds}")
                    own = x > 0 if _positive(op) else np.ones(len(x), dtype=bool)
                    got = None if len(x) < 2 else fit_bounded(op, x[own], w[own], bounds) if bounds is not None else fit_points(op, x, w)
                    scale = Scale(op, bounds, x.min(), x.max(), unit)
                    row += scale.top(x[own], w[own], scale.forth(got)).tolist() if got is not None and all(map(math.isfinite, got)) else [math.nan] * size
                except (ValueError, ZeroDivisionError, FloatingPointError, OverflowError):
                    row += [math.nan] * size
            out.append((row, float(x.min()), float(x.max()), unit))
        return pd.DataFrame(out, columns=["u", "least", "most", "unit"])

    @F.pandas_udf("struct<" + ",".join(f"g{i} double" for i in range(ends[-1])) + ">")
    def gradients(x: pd.Series, cells: pd.Series, us: pd.Series, least: pd.Series, most: pd.Series, unit: pd.Series) -> pd.DataFrame:
        values, out = x.to_numpy(float), np.zeros((len(x), ends[-1]))
        _, first, of = np.unique(cells.to_numpy(), return_index=True, return_inverse=True)
        order = np.argsort(of, kind="stable")
        for rows in np.split(order, np.searchsorted(of[order], np.arange(1, len(first)))):
            k, at = rows[0], np.asarray(us.iloc[rows[0]], dtype=float)
            for scale, a, b in zip(scales(least.iloc[k], most.iloc[k], unit.iloc[k]), ends, ends[1:], strict=False):
                own = rows[values[rows] > 0] if _positive(scale.op) else rows
                if np.isfinite(at[a:b]).all() and len(own):
                    out[own, a:b] = scale.scores(values[own], at[a:b])
        return pd.DataFrame(out, columns=[f"g{i}" for i in range(ends[-1])])

    @F.pandas_udf("array<double>")
    def stepped(points_x: pd.Series, points_w: pd.Series, us: pd.Series, gradient: pd.Series, least: pd.Series, most: pd.Series, unit: pd.Series) -> pd.Series:
        out = []
        for xs, ws, at, g, lo, hi, un in zip(points_x, points_w, us, gradient, least, most, unit, strict=True):
            x, w, at, g = (np.array(v, dtype=float) for v in (xs, ws, at, g))
            for scale, a, b in zip(scales(lo, hi, un), ends, ends[1:], strict=False):
                own = x > 0 if _positive(scale.op) else np.ones(len(x), dtype=bool)
                if np.isfinite(at[a:b]).all() and np.isfinite(g[a:b]).all():
                    at[a:b] = scale.step(x[own], w[own], at[a:b], g[a:b])
            out.append(at)
        return pd.Series(out)

    @F.pandas_udf("array<array<double>>")
    def parameters(us: pd.Series, least: pd.Series, most: pd.Series, unit: pd.Series) -> pd.Series:
        rows = zip(us, least, most, unit, strict=True)
        return pd.Series([[s.found(np.asarray(at)[a:b]) if np.isfinite(np.asarray(at)[a:b]).all() else None for s, a, b in zip(scales(lo, hi, un), ends, ends[1:], strict=False)] for at, lo, hi, un in rows])

    points = weighted_values(df, keys, value, steps, known_as)
    state = points.withColumn(all_, started("points.x", "points.w")).select(*map(name, keys), "points", *(F.col(all_)[c].alias(n) for c, n in (("u", u), ("least", least), ("most", most), ("unit", unit))))
    if rounds:
        # Cells are numbered once, so that a task can tell them apart without their keys.
        state = materialise(state.withColumn(cell, F.monotonically_increasing_id()))
        rows = df.select(*map(name, keys), name(value).alias(x_)).filter(name(x_).isNotNull() & ~name(x_).isin(float("inf"), float("-inf")))
    for done in range(1, (max(rounds, most_rounds) if rounds else 0) + 1):
        small = state.select(*map(name, keys), cell, u, least, most, unit)
        faced = beside(rows, small, keys, known_as) if keys else rows.join(F.broadcast(small))  # without keys there is one row
        scored = faced.select(cell, gradients(x_, cell, u, least, most, unit).alias(sums))
        total = scored.groupBy(cell).agg(F.array(*(F.sum(F.col(sums)[f"g{i}"]) for i in range(ends[-1]))).alias(sums))
        moved = state.join(total, cell).withColumn(before, F.col(u)).withColumn(u, stepped("points.x", "points.w", u, sums, least, most, unit)).drop(sums)
        state = materialise(moved)
        step = F.array_max(F.zip_with(u, before, lambda a, b: F.nanvl(F.abs(a - b), F.lit(0.0))))
        if done >= rounds and (state.agg(F.max(step)).first()[0] or 0) <= SETTLED:
            break
        state = state.drop(before)
    cells = state.select(*map(name, keys), parameters(u, least, most, unit).alias(all_))
    return cells.select(*map(name, keys), *(name(all_)[i].alias(f) for i, f in enumerate(out_)))


def simulate(op: str, params: list[float], n: int, seed: int = 42) -> np.ndarray:
    """Random draws of a family, for tests and demonstrations."""
    rng = np.random.default_rng(seed)
    if op == "Gamma (k, θ)":
        return rng.gamma(params[0], params[1], n)
    if op == "Weibull (k, θ)":
        return params[1] * rng.weibull(params[0], n)
    if op == "LogNormal (k, θ)":
        return rng.lognormal(math.log(params[1]), params[0], n)
    if op in ("Wald (m, a)", "Shifted Wald (m, a, shift)"):
        return rng.wald(params[1] / params[0], params[1] ** 2, n) + (params[2] if len(params) > 2 else 0)
    if op == "Ex-Wald (m, a, τ)":
        return rng.wald(params[1] / params[0], params[1] ** 2, n) + rng.exponential(params[2], n)
    if op == "Ex-Gaussian (μ, σ, τ)":
        return rng.normal(params[0], params[1], n) + rng.exponential(params[2], n)
    if op in ("Inv-Gaussian (μ, λ)", "Shifted Inv-Gaussian (μ, λ, shift)"):
        return rng.wald(params[1], params[0], n) + (params[2] if len(params) > 2 else 0)
    raise ValueError(op)
