"""Second-order numbers: arrays of values with exact gradients and Hessians in a few variables.

A Jet holds n values with their derivatives in m variables: v (n,), g (n, m), h (n, m, m). Ordinary
arithmetic and the functions below carry them by the chain rule, so that a likelihood written for
numbers gives its derivatives without finite differences.
"""

from __future__ import annotations

import numpy as np

from .special import log_gamma, norm_logpdf, norm_logsf

MAX_TERMS = 5000  # of a series or continued fraction; what has not converged by then is NaN
_LN_2PI = float(np.log(2 * np.pi))


class Jet:
    __array_priority__ = 100  # numpy arrays on the left leave the operation to us

    def __init__(self, v, g, h):
        self.v, self.g, self.h = v, g, h

    @classmethod
    def variables(cls, values: np.ndarray) -> list[Jet]:
        """One Jet per column of values (n, m), each its own variable."""
        n, m = values.shape
        eye = np.eye(m)
        return [cls(values[:, j].astype(float), np.broadcast_to(eye[j], (n, m)), np.zeros((n, m, m))) for j in range(m)]

    def of(self, f, f1, f2) -> Jet:
        """A function of this Jet, from its value and first two derivatives."""
        with np.errstate(invalid="ignore", over="ignore"):
            outer = self.g[:, :, None] * self.g[:, None, :]
            return Jet(f, f1[:, None] * self.g, f1[:, None, None] * self.h + f2[:, None, None] * outer)

    def constant(self, value) -> Jet:
        return Jet(np.broadcast_to(np.asarray(value, float), self.v.shape), np.zeros_like(self.g), np.zeros_like(self.h))

    def __neg__(self):
        return Jet(-self.v, -self.g, -self.h)

    def __add__(self, other):
        if isinstance(other, Jet):
            return Jet(self.v + other.v, self.g + other.g, self.h + other.h)
        return Jet(self.v + other, self.g, self.h)

    __radd__ = __add__

    def __sub__(self, other):
        return self + (-other)

    def __rsub__(self, other):
        return -self + other

    def __mul__(self, other):
        if isinstance(other, Jet):
            cross = self.g[:, :, None] * other.g[:, None, :]
            return Jet(self.v * other.v, self.g * other.v[:, None] + other.g * self.v[:, None],
                       self.h * other.v[:, None, None] + other.h * self.v[:, None, None] + cross + np.swapaxes(cross, 1, 2))
        k = np.broadcast_to(np.asarray(other, float), self.v.shape)
        return Jet(self.v * k, self.g * k[:, None], self.h * k[:, None, None])

    __rmul__ = __mul__

    def __truediv__(self, other):
        return self * (reciprocal(other) if isinstance(other, Jet) else 1.0 / np.asarray(other, float))

    def __rtruediv__(self, other):
        return reciprocal(self) * other

    def __pow__(self, k: float):
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.of(self.v ** k, k * self.v ** (k - 1), k * (k - 1) * self.v ** (k - 2))

    def __getitem__(self, rows) -> Jet:
        return Jet(self.v[rows], self.g[rows], self.h[rows])


def reciprocal(x: Jet) -> Jet:
    with np.errstate(divide="ignore", invalid="ignore"):
        r = 1.0 / x.v
        return x.of(r, -r * r, 2 * r ** 3)


def exp(x: Jet) -> Jet:
    with np.errstate(over="ignore"):
        e = np.exp(x.v)
    return x.of(e, e, e)


def log(x: Jet) -> Jet:
    with np.errstate(divide="ignore", invalid="ignore"):
        return x.of(np.log(x.v), 1.0 / x.v, -1.0 / x.v ** 2)


def log1mexp(x: Jet) -> Jet:
    """log(1 - e^x) for x < 0."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        value = np.where(x.v > -0.6931471805599453, np.log(-np.expm1(x.v)), np.log1p(-np.exp(x.v)))
        r = 1.0 / np.expm1(-x.v)
        return x.of(value, -r, -r * (1 + r))


def where(condition: np.ndarray, x, y) -> Jet:
    """x or y by row; either may be a number. Derivatives of the row not taken do not leak, even if NaN."""
    jet = x if isinstance(x, Jet) else y
    x, y = (t if isinstance(t, Jet) else jet.constant(t) for t in (x, y))
    c = np.asarray(condition, bool)
    return Jet(np.where(c, x.v, y.v), np.where(c[:, None], x.g, y.g), np.where(c[:, None, None], x.h, y.h))


def norm_log_sf(x: Jet) -> Jet:
    """Log of the upper normal tail."""
    value = norm_logsf(x.v)
    with np.errstate(over="ignore", invalid="ignore"):
        hazard = np.exp(norm_logpdf(x.v) - value)
        return x.of(value, -hazard, -hazard * (hazard - x.v))


def digamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(10):  # up to 10 by recurrence, then the asymptotic series
        out, x = out - np.where(x < 10, 1 / x, 0.0), np.where(x < 10, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(10):
        out, x = out + np.where(x < 10, 1 / (x * x), 0.0), np.where(x < 10, x + 1, x)
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r * (1 / 30 - r * 5 / 66))))


def lgamma(x: Jet) -> Jet:
    return x.of(log_gamma(x.v), digamma(x.v), trigamma(x.v))


def log_gamma_sf(a: Jet, x: Jet) -> Jet:
    """Log of the upper regularised incomplete gamma Q(a, x); derivatives run through the series below
    a + 1 and the continued fraction above. x = 0 gives 0; NaN where neither converges."""
    out = a.constant(np.nan)
    out = Jet(out.v.copy(), out.g.copy(), out.h.copy())
    good = np.isfinite(a.v) & (a.v > 0) & np.isfinite(x.v)
    for rows, part in ((good & (x.v > 0) & (x.v < a.v + 1), _by_series), (good & (x.v >= a.v + 1), _by_fraction)):
        if rows.any():
            got = part(a[rows], x[rows])
            out.v[rows], out.g[rows], out.h[rows] = got.v, got.g, got.h
    zero = good & (x.v <= 0)
    out.v[zero], out.g[zero], out.h[zero] = 0.0, 0.0, 0.0
    return out


def _front(a: Jet, x: Jet) -> Jet:
    return a * log(x) - x - lgamma(a)


def _small(term: Jet, total: Jet, share: float) -> np.ndarray:
    """Rows whose term changes the total by no more than a share of it; of derivatives, a hundred times that."""
    def most(x):
        return np.abs(x.v), np.abs(x.g).max(1), np.abs(x.h).max((1, 2))

    (v, g, h), (tv, tg, th) = most(term), most(total)
    return (v <= share * tv) & (g <= 100 * share * (tv + tg)) & (h <= 100 * share * (tv + th))


def _by_series(a: Jet, x: Jet) -> Jet:
    term = reciprocal(a)
    total, done = term, np.zeros(len(a.v), bool)
    for k in range(1, MAX_TERMS):
        term = term * x / (a + float(k))
        total = total + term
        done = _small(term, total, 1e-17)
        if done.all():
            break
    lower = _front(a, x) + log(total)
    return where(done, log1mexp(lower), np.nan)


def _by_fraction(a: Jet, x: Jet) -> Jet:
    """1 / (x + 1 - a - 1 (1 - a) / (x + 3 - a - ...)) by its convergents' numerators and denominators."""
    b = x - a + 1.0
    n0, n1 = a.constant(0.0), a.constant(1.0)
    d0, d1 = a.constant(1.0), b
    value, done = n1 / d1, np.zeros(len(a.v), bool)
    for k in range(1, MAX_TERMS):
        c = (a - float(k)) * float(k)
        b = b + 2.0
        n0, n1 = n1, b * n1 + c * n0
        d0, d1 = d1, b * d1 + c * d0
        size = 1.0 / np.maximum(np.abs(d1.v), 1e-300)  # the ratio does not change
        n0, n1, d0, d1 = (t * size for t in (n0, n1, d0, d1))
        new = n1 / d1
        now = _small(new - value, new, 1e-14)
        value = where(done, value, new)  # what has converged stays
        done = done | now
        if done.all():
            break
    return where(done, _front(a, x) + log(value), np.nan)
