"""Special functions and distribution functions in NumPy, for use inside tasks."""

from __future__ import annotations

import math

import numpy as np

_erfc = np.frompyfunc(math.erfc, 1, 1)


def erfc(x: np.ndarray) -> np.ndarray:
    return np.asarray(_erfc(np.asarray(x, dtype=float)), dtype=float)


def phi(x: np.ndarray) -> np.ndarray:
    """The standard normal distribution function."""
    return 0.5 * erfc(-np.asarray(x, dtype=float) / math.sqrt(2))


def log_phi(x: np.ndarray) -> np.ndarray:
    """Its logarithm, by an asymptotic series far to the left."""
    x = np.asarray(x, dtype=float)
    far = x < -8
    out = np.log(np.maximum(phi(np.where(far, 0.0, x)), 1e-300))
    z = np.where(far, x, -10.0)
    i = 1 / (z * z)
    return np.where(far, -0.5 * z * z - 0.5 * math.log(2 * math.pi) - np.log(-z) + np.log1p(-i + 3 * i**2 - 15 * i**3 + 105 * i**4), out)


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 8, then an asymptotic series."""
    x, shift = np.array(x, dtype=float), 0.0
    while np.any(x < 8):
        shift = shift - np.where(x < 8, 1 / x, 0.0)
        x = np.where(x < 8, x + 1, x)
    i = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, shift = np.array(x, dtype=float), 0.0
    while np.any(x < 8):
        shift = shift + np.where(x < 8, 1 / (x * x), 0.0)
        x = np.where(x < 8, x + 1, x)
    i = 1 / (x * x)
    return shift + 1 / x + i / 2 + i / x * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30)))


def faddeeva(z: np.ndarray, terms: int = 32) -> np.ndarray:
    """w(z) in the upper half plane, by the rational approximation of Weideman (1994)."""
    m = 2 * terms
    k = np.arange(-m + 1, m)
    scale = math.sqrt(terms / math.sqrt(2))
    t = scale * np.tan(k * np.pi / (2 * m))
    f = np.concatenate(([0.0], np.exp(-t * t) * (scale * scale + t * t)))
    a = np.real(np.fft.fft(np.fft.fftshift(f))) / (2 * m)
    ratio = (scale + 1j * z) / (scale - 1j * z)
    return 2 * np.polyval(a[1 : terms + 1][::-1], ratio) / (scale - 1j * z) ** 2 + (1 / math.sqrt(math.pi)) / (scale - 1j * z)


def wald_logpdf(x: np.ndarray, m: float, a: float) -> np.ndarray:
    """First passage of a drifting walk: drift m, threshold a."""
    return math.log(a) - 0.5 * np.log(2 * np.pi * x**3) - (a - m * x) ** 2 / (2 * x)


def wald_cdf(x: np.ndarray, m: float, a: float) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    root = np.sqrt(np.maximum(x, 1e-300))
    return np.where(x > 0, np.clip(phi((m * x - a) / root) + np.exp(np.minimum(2 * a * m + log_phi(-(m * x + a) / root), 0)), 0, 1), 0.0)


def exwald_pdf(x: np.ndarray, m: float, a: float, tau: float) -> np.ndarray:
    """A Wald time plus an exponential one with mean tau."""
    x = np.asarray(x, dtype=float)
    k = m * m - 2 / tau
    if k >= 0:
        r = math.sqrt(k)
        return np.exp(np.clip(a * (m - r) - x / tau, -700, 700)) / tau * wald_cdf(x, r, a)
    z = np.sqrt(-k * x / 2) + 1j * a / np.sqrt(2 * x)
    return np.exp(np.clip(m * a - a * a / (2 * x) - x * m * m / 2, -700, 700)) / tau * np.real(faddeeva(z))


def exwald_cdf(x: np.ndarray, m: float, a: float, tau: float) -> np.ndarray:
    return np.clip(wald_cdf(x, m, a) - tau * exwald_pdf(x, m, a, tau), 0, 1)


def exgauss_logpdf(x: np.ndarray, mu: float, sigma: float, tau: float) -> np.ndarray:
    z = (np.asarray(x, dtype=float) - mu) / sigma
    return -math.log(tau) - z * sigma / tau + sigma * sigma / (2 * tau * tau) + log_phi(z - sigma / tau)


def exgauss_cdf(x: np.ndarray, mu, sigma, tau) -> np.ndarray:
    """Also for arrays of parameters, one for each x."""
    z, r = (np.asarray(x, dtype=float) - mu) / sigma, sigma / tau
    return np.clip(phi(z) - np.exp(np.clip(-z * r + r * r / 2 + log_phi(z - r), -745, 0)), 0, 1)


def weibull_cdf(x: np.ndarray, k: float, theta: float) -> np.ndarray:
    return np.clip(-np.expm1(-((np.maximum(x, 0) / theta) ** k)), 0, 1)


def lognormal_cdf(x: np.ndarray, k: float, theta: float) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    return np.where(x > 0, phi(np.log(np.maximum(x, 1e-300) / theta) / k), 0.0)


def gamma_cdf(x: np.ndarray, k: float, theta: float) -> np.ndarray:
    """Regularised lower incomplete gamma: a series to the left of k + 1, a continued fraction beyond."""

    def one(v: float) -> float:
        if v <= 0:
            return 0.0
        front = math.exp(k * math.log(v) - v - math.lgamma(k))
        if v < k + 1:
            term = total = 1 / k
            n = k
            while term > total * 1e-15:
                n += 1
                term *= v / n
                total += term
            return min(1.0, total * front)
        b, c = v + 1 - k, 1e300
        d = 1 / b
        h = d
        for i in range(1, 500):
            an = -i * (i - k)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return max(0.0, 1 - front * h)

    return np.array([one(float(v)) for v in np.atleast_1d(np.asarray(x, dtype=float) / theta)])


def invgauss_cdf(x: np.ndarray, shape: float, mean: float, shift: float = 0.0) -> np.ndarray:
    """Inverse Gaussian by shape and mean: a Wald time with threshold sqrt(shape) and drift sqrt(shape) / mean."""
    return wald_cdf(np.asarray(x, dtype=float) - shift, math.sqrt(shape) / mean, math.sqrt(shape))
