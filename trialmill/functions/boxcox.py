"""Box-Cox transform with the maximum-likelihood lambda, in three aggregations whatever the data.

The first finds the mean and spread of ln x, the second counts narrow bins of it, the third makes one exact Newton step.
In between the driver scans all lambdas over the bins, whose number grows with the logarithm of the spread only.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins for each standard deviation of ln x near its mean; they widen in the tails.
STEPS = 1024
#: Lambdas of the scan, spread evenly by their inverse hyperbolic sine, and how far it goes; both in units of one over the spread of ln x.
POINTS, REACH = 401, 60.0
#: Below this lambda differences are summed as series.
NEAR_ZERO = 1e-3


def _log_variance(y: np.ndarray, w: np.ndarray, v: float) -> float:
    """Logarithm of the variance of (e^(v y) - 1) / v, without overflow."""
    if abs(v) < 1e-12:
        t, top = y, 0.0
    else:
        top = max(0.0, (v * y).max())
        t = (np.exp(v * y - top) - math.exp(-top)) / v
    return 2 * top + math.log(max(np.average((t - np.average(t, weights=w)) ** 2, weights=w), 1e-300))


def _scan(y: np.ndarray, w: np.ndarray) -> float:
    """The lambda with the least variance over weighted points of spread one."""
    from .fits import narrow

    loss = lambda v: _log_variance(y, w, v)
    at = np.sinh(np.linspace(-math.asinh(REACH), math.asinh(REACH), POINTS))
    k = int(np.argmin([loss(v) for v in at]))
    return narrow(loss, at[max(0, k - 1)], at[min(POINTS - 1, k + 1)], grid=9)


def _moving(y: Column, v: float) -> tuple[Column, Column]:
    """(e^(v y) - 1) / v and its derivative by v."""
    if abs(v) < NEAR_ZERO:
        # Terms beyond these are below rounding for such v.
        powers = [F.lit(1.0)]
        for _ in range(6):
            powers.append(powers[-1] * y)
        t = sum((powers[k + 1] * (v**k / math.factorial(k + 1)) for k in range(5)), F.lit(0.0))
        return t, sum((powers[k + 1] * (k * v ** (k - 1) / math.factorial(k + 1)) for k in range(1, 6)), F.lit(0.0))
    t = F.expm1(y * v) / v
    return t, (y * F.exp(y * v) - t) / v


def best_lambda(df: DataFrame, x: Column) -> float:
    """lambda that maximises the likelihood of positive x; 1 where there is no x or no spread.

    With x divided by its geometric mean, on which lambda doesn't depend, only the variance is left of the likelihood.
    """
    logs = F.ln(x)
    first = df.agg(F.min(x).alias("least"), F.avg(logs).alias("mean"), F.stddev_pop(logs).alias("spread")).first()
    if first["least"] is None:
        return 1.0
    if first["least"] <= 0:
        raise ValueError("Box-Cox needs values above zero")
    if not first["spread"] or not math.isfinite(first["spread"]):
        return 1.0
    y = (logs - F.lit(first["mean"])) / F.lit(first["spread"])
    place = F.floor(F.asinh(y) * STEPS).alias("place")
    bins = df.select(y.alias("y"), place).filter("y is not null").groupBy("place").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).toPandas()
    points, w = bins["y"].to_numpy(float), bins["n"].to_numpy(float)
    v = _scan(points, w)
    # One Newton step: the slope over all rows, the curvature over the points.
    t, slope = _moving(y, v)
    row = df.agg(F.covar_pop(t, slope).alias("c"), F.var_pop(t).alias("v")).first()
    h = 1e-3 * max(1.0, abs(v))
    bend = (_log_variance(points, w, v + h) - 2 * _log_variance(points, w, v) + _log_variance(points, w, v - h)) / (h * h)
    if row["v"] and math.isfinite(row["c"]) and bend > 0:
        step = 2 * row["c"] / row["v"] / bend
        v -= step if abs(step) < h else 0.0
    return v / first["spread"]


def _power(x: Column, v: float) -> Column:
    return F.ln(x) if abs(v) < 1e-12 else (F.pow(x, F.lit(v)) - 1) / v


def transform(df: DataFrame, x: Column) -> Column:
    return _power(x, best_lambda(df, x))
