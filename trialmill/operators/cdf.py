"""Pooled cumulative probabilities: an ex-Gaussian fit for each cell, and the mixture that finds omega."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fits, special
from ..functions.stats import Shape, beside, fresh, name, number

#: Trials that a cell needs.
LEAST_TRIALS = 50
#: Where the mixture is fitted, and equal bins of its tail that reach the driver.
TAIL, TAIL_BINS = 0.7, 3000
P_BOUNDS, OMEGA_BOUNDS, DENSITY_FLOOR = (1e-4, 0.2), (0.7, 0.999), 1e-12


def pooled(df: DataFrame, var: str, keys: list[str], least: int = LEAST_TRIALS) -> DataFrame:
    """df with `<var>_cdf`; rows with a missing key belong to no cell and go."""
    target = f"{var}_cdf"
    own = df.drop(target).withColumn(var, number(df, var))
    if keys:
        own = own.filter(" and ".join(f"`{k}` is not null" for k in keys))
    # One count over the keys guards the cells' size and says how their parameters meet the rows.
    sizes = own.groupBy(*map(name, keys)).agg(F.count(F.lit(1)).alias("trials"))
    small, cells, largest = sizes.agg(F.count_if(F.col("trials") < least), F.count(F.lit(1)), F.max("trials")).first()
    if small or not cells:
        raise ValueError(f"{small or 'all'} cells have fewer than {least} trials")
    known_as = Shape(largest, cells)

    @F.pandas_udf(T.DoubleType())
    def probability(x: pd.Series, mu: pd.Series, sigma: pd.Series, tau: pd.Series) -> pd.Series:
        return pd.Series(special.exgauss_cdf(x.to_numpy(float), mu.to_numpy(float), sigma.to_numpy(float), tau.to_numpy(float)))

    (fit,) = fresh(own, "fit")
    params = fits.fit_cells(own, keys, var, ["Ex-Gaussian (μ, σ, τ)"], known_as=known_as)
    params = params.withColumnRenamed(params.columns[-1], fit)
    if keys:
        # Every cell has a row, with null where nothing could be fitted.
        faced = beside(own, sizes.select(*map(name, keys)).join(params, keys, "left"), keys, known_as)
    else:
        got = params.first()
        faced = own.withColumn(fit, F.lit(got[fit] if got else None).cast("array<double>"))
    p = probability(name(var), *(F.get(name(fit), F.lit(i)) for i in range(3)))
    return faced.withColumn(target, F.when(name(var).isNotNull() & name(fit).isNotNull(), p)).drop(fit)


def fit_omega(marked: DataFrame, target: str) -> tuple[float, float]:
    """(p, omega) of the mixture 1 - p everywhere and p * 2 (c - omega) / (1 - omega)^2 above omega.

    Below TAIL a value only counts; the rest reaches the driver as TAIL_BINS weighted bins.
    """
    c = name(target)
    place = F.least(F.floor((c - TAIL) / (1 - TAIL) * TAIL_BINS), F.lit(TAIL_BINS - 1))
    rows = marked.filter(c.isNotNull()).groupBy(F.when(c >= TAIL, place).alias("b")).agg(F.avg(c).alias("c"), F.count(F.lit(1)).alias("n")).toPandas()
    below = float(rows.loc[rows["b"].isna(), "n"].sum())
    rows = rows[rows["b"].notna()]
    x, w = rows["c"].to_numpy(float), rows["n"].to_numpy(float)

    def best_p(omega: float) -> tuple[float, float]:
        extra = np.where(x >= omega, 2 * (x - omega) / (1 - omega) ** 2, 0.0) - 1
        p = 0.01
        for _ in range(60):
            d = np.maximum(1 + p * extra, DENSITY_FLOOR)
            g = (w * extra / d).sum() - below / (1 - p)
            h = -(w * (extra / d) ** 2).sum() - below / (1 - p) ** 2
            step = g / h
            p = float(np.clip(p - step, *P_BOUNDS))
            if abs(step) < 1e-12:
                break
        return p, -float((w * np.log(np.maximum(1 + p * extra, DENSITY_FLOOR))).sum() + below * np.log1p(-p))

    omega = fits.narrow(lambda o: best_p(o)[1], *OMEGA_BOUNDS, grid=120)
    return best_p(omega)[0], omega


def histogram(marked: DataFrame, target: str, bins: int = 100) -> DataFrame:
    """(bin, low, high, n): the counts behind a plot of pooled probabilities."""
    b = F.least(F.floor(name(target) * bins), F.lit(bins - 1)).cast("long")
    return marked.filter(name(target).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), "n")


def density(c: np.ndarray, p: float, omega: float) -> np.ndarray:
    """The fitted curve."""
    return 1 - p + np.where(c >= omega, p * 2 * (c - omega) / (1 - omega) ** 2, 0.0)


def apply_rule(df: DataFrame, var: str, keys: list[str], omega: float | str | None, keep: str = "above") -> DataFrame:
    """Mark rows and keep those above omega (as the rule always did) or below it (as its purpose says)."""
    marked = pooled(df, var, keys)
    if omega == "estimate":
        omega = fit_omega(marked, f"{var}_cdf")[1]
    if omega is None or not 0 < float(omega) < 1:
        return marked
    c = name(f"{var}_cdf")
    return marked.filter(c > omega if keep == "above" else c <= omega)


def simulate(n: int = 5000, p: float = 0.03, omega: float = 0.98, seed: int = 42) -> np.ndarray:
    """Pooled probabilities under the mixture."""
    rng = np.random.default_rng(seed)
    out = rng.random(n) < p
    return np.where(out, omega + (1 - omega) * np.sqrt(rng.random(n)), rng.random(n))
