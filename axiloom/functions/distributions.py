"""Distributions whose cdf and ppf are written once and run on NumPy arrays and on Columns alike."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@runtime_checkable
class Distribution(Protocol):
    """What a random index needs: cdf, rvs, mean, std. One that also has ppf can be drawn on the executors."""

    def cdf(self, x, *args, **kwds): ...

    def rvs(self, size=None, **kwargs): ...

    def mean(self, *args, **kwds): ...

    def std(self, *args, **kwds): ...


def _where(c, a, b):
    if isinstance(c, Column):
        return F.when(c, a).otherwise(b)
    return np.where(c, a, b)


def _fn(name: str):
    on_columns, on_arrays = getattr(F, name), getattr(np, {"ln": "log"}.get(name, name))

    def call(x):
        if isinstance(x, Column):
            return on_columns(x)
        with np.errstate(all="ignore"):
            return on_arrays(x)

    return call


_exp, _ln, _sqrt, _abs = (_fn(n) for n in ("exp", "ln", "sqrt", "abs"))


def _horner(c: Sequence[float], x):
    out = c[0]
    for k in c[1:]:
        out = out * x + k
    return out


# A rational approximation of the normal tail (double precision), and one of the normal quantile.
_TAIL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_LOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
_Q_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_Q_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_Q_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_Q_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_Q_EDGE = 0.02425


def _let(x, body):
    """body(x), with a column computed once however often body uses it."""
    return F.transform(F.array(x), body)[0] if isinstance(x, Column) else body(x)


def _tail(z):
    density = _exp(z * z * -0.5)
    near = density * _horner(_TAIL_TOP, z) / _horner(_TAIL_LOW, z)
    far = density / (z + 1.0 / (z + 2.0 / (z + 3.0 / (z + 4.0 / (z + 0.65))))) / math.sqrt(2 * math.pi)
    return _where(z < 7.07106781186547, near, far)


def normal_cdf(x):
    def signed(x):
        z = _abs(x)
        return _let(_let(_where(z > 38.0, 38.0, z), _tail), lambda t: _where(x > 0, 1.0 - t, t))

    return _let(x, signed)


def _quantile_guess(low):
    q = low - 0.5
    middle = _let(q * q, lambda r: q * _horner(_Q_A, r) / _horner(_Q_B, r))
    outer = _let(_sqrt(_ln(low) * -2.0), lambda t: _horner(_Q_C, t) / _horner(_Q_D, t))
    return _where(low < _Q_EDGE, outer, middle)


def normal_ppf(p):
    """A first guess in the lower half, one step of Halley's method, and the sign of the half."""

    def refined(low):
        def step(x):
            error = (normal_cdf(x) - low) * math.sqrt(2 * math.pi) * _exp(x * x * 0.5)
            return _let(error, lambda e: x - e / (x * e * 0.5 + 1.0))

        return _let(_quantile_guess(low), step)

    def whole(p):
        low = _where(p < 0.5, p, 1.0 - p)
        x = _let(_where(low > 0, low, 0.25), refined)
        x = _where(low <= 0, -math.inf, x)
        return _let(x, lambda x: _where(p > 0.5, x * -1.0, x))

    return _let(p, whole)


class _Base:
    """rvs by inversion of uniforms from ``random_state`` (a Generator, a RandomState, or NumPy's global one)."""

    def rvs(self, size=None, random_state=None):
        source = np.random if random_state is None else random_state
        u = source.uniform(0.0, 1.0, size)
        out = self.ppf(u)
        return float(out) if size is None else np.asarray(out)

    def var(self):
        return self.std() ** 2


@dataclass(frozen=True)
class Uniform(_Base):
    loc: float = 0.0
    scale: float = 1.0

    def cdf(self, x):
        z = (x - self.loc) / self.scale
        return _where(z <= 0, 0.0, _where(z >= 1, 1.0, z))

    def ppf(self, u):
        return u * self.scale + self.loc

    def mean(self):
        return self.loc + self.scale / 2

    def std(self):
        return self.scale / math.sqrt(12)


@dataclass(frozen=True)
class Normal(_Base):
    loc: float = 0.0
    scale: float = 1.0

    def cdf(self, x):
        return normal_cdf((x - self.loc) / self.scale)

    def ppf(self, u):
        return normal_ppf(u) * self.scale + self.loc

    def mean(self):
        return self.loc

    def std(self):
        return self.scale


@dataclass(frozen=True)
class LogNormal(_Base):
    s: float = 1.0
    loc: float = 0.0
    scale: float = 1.0

    def cdf(self, x):
        z = (x - self.loc) / self.scale
        inside = _where(z > 0, z, 1.0)
        return _where(z > 0, normal_cdf(_ln(inside) / self.s), 0.0)

    def ppf(self, u):
        return _exp(normal_ppf(u) * self.s) * self.scale + self.loc

    def mean(self):
        return self.loc + self.scale * math.exp(self.s**2 / 2)

    def std(self):
        return self.scale * math.sqrt((math.exp(self.s**2) - 1) * math.exp(self.s**2))


@dataclass(frozen=True)
class Triangular(_Base):
    c: float = 0.5
    loc: float = 0.0
    scale: float = 1.0

    def cdf(self, x):
        z = (x - self.loc) / self.scale
        rise = z * z / self.c if self.c > 0 else z * 0.0
        fall = 1.0 - (1.0 - z) * (1.0 - z) / (1.0 - self.c) if self.c < 1 else z * 0.0 + 1.0
        return _where(z <= 0, 0.0, _where(z >= 1, 1.0, _where(z < self.c, rise, fall)))

    def ppf(self, u):
        rise, fall = _sqrt(u * self.c), 1.0 - _sqrt((1.0 - u) * (1.0 - self.c))
        return _where(u < self.c, rise, fall) * self.scale + self.loc

    def mean(self):
        return self.loc + self.scale * (1 + self.c) / 3

    def std(self):
        return self.scale * math.sqrt((1 - self.c + self.c**2) / 18)


@dataclass(frozen=True)
class TruncatedNormal(_Base):
    """Normal between a and b, which are in standard deviations from loc."""

    a: float
    b: float
    loc: float = 0.0
    scale: float = 1.0

    def _ends(self) -> tuple[float, float]:
        return float(normal_cdf(np.float64(self.a))), float(normal_cdf(np.float64(self.b)))

    def cdf(self, x):
        low, high = self._ends()
        z = (x - self.loc) / self.scale
        inside = (normal_cdf(z) - low) / (high - low)
        return _where(z <= self.a, 0.0, _where(z >= self.b, 1.0, inside))

    def ppf(self, u):
        low, high = self._ends()
        return normal_ppf(u * (high - low) + low) * self.scale + self.loc

    def _moments(self) -> tuple[float, float]:
        low, high = self._ends()
        phi = lambda x: math.exp(-x * x / 2) / math.sqrt(2 * math.pi) if math.isfinite(x) else 0.0
        weighted = lambda x: x * phi(x) if math.isfinite(x) else 0.0
        m = (phi(self.a) - phi(self.b)) / (high - low)
        return m, 1 + (weighted(self.a) - weighted(self.b)) / (high - low) - m * m

    def mean(self):
        return self.loc + self.scale * self._moments()[0]

    def std(self):
        return self.scale * math.sqrt(self._moments()[1])


def uniform(loc: float = 0.0, scale: float = 1.0) -> Uniform:
    return Uniform(loc, scale)


def norm(loc: float = 0.0, scale: float = 1.0) -> Normal:
    return Normal(loc, scale)


def lognorm(s: float, loc: float = 0.0, scale: float = 1.0) -> LogNormal:
    return LogNormal(s, loc, scale)


def triang(c: float, loc: float = 0.0, scale: float = 1.0) -> Triangular:
    return Triangular(c, loc, scale)


def truncnorm(a: float, b: float, loc: float = 0.0, scale: float = 1.0) -> TruncatedNormal:
    return TruncatedNormal(a, b, loc, scale)


def _on_batches(f: Callable[[np.ndarray], Any], x: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series(np.asarray(f(s.to_numpy(float)), float)), "double")(x)


def _on_column(f: Callable[[Any], Any], x: Column) -> Column:
    """f(x) as a Column if f is written for them, else on Arrow batches: a distribution may know arrays only."""
    try:
        out = f(x)
        if isinstance(out, Column):
            return out
    except Exception:  # whatever array code makes of a Column
        pass
    return _on_batches(f, x)


def column_ppf(d: Any, u: Column) -> Column:
    return _on_column(d.ppf, u)


def column_cdf(d: Any, x: Column) -> Column:
    return _on_column(d.cdf, x)


def poisson_cdf(k: Any, mu: Any) -> np.ndarray:
    """P(X <= k) for a Poisson mean mu, on arrays: the regularised upper incomplete gamma function, by the series below
    mu < k + 2 and by the continued fraction above, all elements at once until each has settled."""
    k, mu = np.broadcast_arrays(np.floor(np.asarray(k, float)), np.asarray(mu, float))
    a, x = (k + 1).ravel(), mu.ravel().astype(float)
    out = np.where(np.isnan(a) | np.isnan(x), math.nan, np.where(a <= 0, 0.0, 1.0))
    inside = (a > 0) & (x > 0)
    for some, f in ((inside & (x < a + 1), _lower_series), (inside & (x >= a + 1), _upper_fraction)):
        if some.any():
            front = np.exp(a[some] * np.log(x[some]) - x[some] - _log_gamma(a[some]))
            out[some] = f(a[some], x[some], front)
    return out.reshape(k.shape)


def _log_gamma(a: np.ndarray) -> np.ndarray:
    values, at = np.unique(a, return_inverse=True)
    return np.array([math.lgamma(v) for v in values])[at]


def _lower_series(a: np.ndarray, x: np.ndarray, front: np.ndarray) -> np.ndarray:
    term = total = 1 / a
    n = a
    while (term > total * 1e-17).any():
        n = n + 1
        term = term * x / n
        total = total + term
    return 1 - front * total


def _upper_fraction(a: np.ndarray, x: np.ndarray, front: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    b = x + 1 - a
    c, d = np.full(a.shape, 1e300), 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) > tiny, d, tiny)
        c = b + an / np.where(np.abs(c) > tiny, c, tiny)
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    return front * h


def student_ppf(p: float, df: float) -> float:
    """Quantile of Student's t, by bisection on its cdf (the incomplete beta function's continued fraction)."""
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -student_ppf(1 - p, df)
    low, high = 0.0, 1.0
    while _student_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _student_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def _student_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    return 1 - 0.5 * _beta_share(df / 2, 0.5, x)


def _beta_share(a: float, b: float, x: float) -> float:
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or 1e-300)
        c = 1 + n / c
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)
