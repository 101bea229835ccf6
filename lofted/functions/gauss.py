"""Normal distribution and the three marginals of a design, as Columns and in NumPy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LIMIT = 8.0
#: Where the series of erf ends and the continued fraction of erfc begins, and the terms of each.
_SPLIT, _SERIES, _FRACTION = 2.0, 40, 60
# The rational approximations of algorithm AS 241 (numerator, denominator, from the highest power).
_CENTRE = (
    (2.50908092873012267e3, 3.34305755835881281e4, 6.72657709270087009e4, 4.59219539315498715e4, 1.37316937655094611e4, 1.97159095030655144e3, 1.33141667891784377e2, 3.38713287279636661e0),
    (5.22649527885285456e3, 2.87290857357219427e4, 3.93078958000927106e4, 2.12137943015865959e4, 5.39419602142475111e3, 6.87187007492057908e2, 4.23133307016009113e1, 1.0),
)
_MIDDLE = (
    (7.74545014278341408e-4, 2.27238449892691846e-2, 2.41780725177450612e-1, 1.27045825245236838e0, 3.64784832476320461e0, 5.76949722146069141e0, 4.63033784615654530e0, 1.42343711074968358e0),
    (1.05075007164441684e-9, 5.47593808499534494e-4, 1.51986665636164572e-2, 1.48103976427480075e-1, 6.89767334985100005e-1, 1.67638483018380385e0, 2.05319162663775882e0, 1.0),
)
_TAIL = (
    (2.01033439929228813e-7, 2.71155556874348758e-5, 1.24266094738807844e-3, 2.65321895265761231e-2, 2.96560571828504891e-1, 1.78482653991729133e0, 5.46378491116411437e0, 6.65790464350110378e0),
    (2.04426310338993979e-15, 1.42151175831644589e-7, 1.84631831751005468e-5, 7.86869131145613259e-4, 1.48753612908506149e-2, 1.36929880922735805e-1, 5.99832206555887938e-1, 1.0),
)


def pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _power_series(coefficients, x):
    """A polynomial from its highest power down."""
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def erfc(x: Column) -> Column:
    """Complementary error function: the series of erf near 0, a continued fraction beyond."""
    size = F.abs(x)
    terms = [(-1) ** n / (math.factorial(n) * (2 * n + 1)) for n in range(_SERIES, -1, -1)]
    near = 1 - 2 / math.sqrt(math.pi) * size * _power_series([F.lit(terms[0]), *terms[1:]], size * size)
    below = size
    for k in range(_FRACTION, 0, -1):
        below = size + (k / 2) / below
    far = F.exp(-size * size) / (math.sqrt(math.pi) * below)
    tail = F.when(size < _SPLIT, near).otherwise(far)
    return F.when(x < 0, 2 - tail).otherwise(tail)


def cdf(x: Column) -> Column:
    return erfc(-x / math.sqrt(2)) / 2


def upper_tail(x: Column) -> Column:
    return erfc(x / math.sqrt(2)) / 2


def inverse_cdf(u: Column, limit: float = LIMIT) -> Column:
    """Quantile of the unit normal, held at plus and minus `limit`; null outside [0, 1]."""
    q = u - 0.5
    ratio = lambda parts, r: _power_series([F.lit(parts[0][0]), *parts[0][1:]], r) / _power_series([F.lit(parts[1][0]), *parts[1][1:]], r)
    r = F.sqrt(-F.log(F.least(u, 1 - u)))
    outer = F.when(r <= 5, ratio(_MIDDLE, r - 1.6)).otherwise(ratio(_TAIL, r - 5))
    x = F.when(F.abs(q) <= 0.425, q * ratio(_CENTRE, 0.180625 - q * q)).when(q < 0, -outer).otherwise(outer)
    held = F.greatest(F.lit(-limit), F.least(F.lit(limit), x))
    return F.when((u > 0) & (u < 1), held).when(u == 0, -limit).when(u == 1, limit)


def _named(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f uses it."""
    return F.transform(F.array(x), f)[0]


#: From here on a tail's probability is too small for the quantile's approximation.
_FAR_TAIL = 30.0


def truncated(u: Column, mean: float, sd: float, low: float, high: float, above: Column | None = None) -> Column:
    """Quantile at u, in (0, 1), of a normal cut to [low, high] and, where `above` is not
    null, to what lies beyond it; `above` itself where nothing does.

    It is sought by the probability of the upper tail, which stays exact where the
    cut is far out; beyond _FAR_TAIL deviations by the density's leading term there.
    """
    bound = F.lit(float(low)) if above is None else F.greatest(F.lit(float(low)), above)
    to = (high - mean) / sd
    last = math.erfc(to / math.sqrt(2)) / 2

    def drawn(at: Column) -> Column:
        from_, v = at["z"], at["u"]
        near = _named(last + (1 - v) * (upper_tail(from_) - last), lambda t: -inverse_cdf(t, 38.0))
        cut = -F.expm1((from_ * from_ - to * to) / 2) if math.isfinite(to) else F.lit(1.0)
        return F.when(from_ < _FAR_TAIL, near).otherwise(F.sqrt(from_ * from_ - 2 * F.log1p(-v * cut)))

    z = _named(F.struct(((bound - mean) / sd).alias("z"), u.alias("u")), drawn)
    return F.greatest(bound, F.least(F.lit(float(high)), mean + sd * z))


def inverse_np(u: np.ndarray) -> np.ndarray:
    """`inverse_cdf` in NumPy; NaN outside [0, 1]."""
    u = np.asarray(u, float)
    with np.errstate(all="ignore"):
        q = u - 0.5
        r = np.sqrt(-np.log(np.minimum(u, 1 - u)))
        ratio = lambda parts, x: _power_series(parts[0], x) / _power_series(parts[1], x)
        outer = np.where(r <= 5, ratio(_MIDDLE, r - 1.6), ratio(_TAIL, r - 5))
        x = np.where(np.abs(q) <= 0.425, q * ratio(_CENTRE, 0.180625 - q * q), np.where(q < 0, -outer, outer))
        x = np.clip(np.where(u == 0, -LIMIT, np.where(u == 1, LIMIT, x)), -LIMIT, LIMIT)
    return np.where((u >= 0) & (u <= 1), x, np.nan)


def ellipse_scale(confidence: Column | float) -> Column:
    """Radius in standard deviations that holds this share of a plane normal."""
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.sqrt(-2 * F.log(1 - c))


@dataclass(frozen=True)
class Distribution:
    """kind: uniform (low, high), normal (mean, sd, clamped to low and high) or fixed (mean)."""

    kind: str
    mean: float = 0.0
    sd: float = 0.0
    low: float = -math.inf
    high: float = math.inf

    @classmethod
    def symmetric(cls, mean: float, sd: float, sigmas: float = 3.0) -> Distribution:
        """A normal cut at so many standard deviations on either side."""
        return cls("normal", mean, sd, mean - sigmas * sd, mean + sigmas * sd)

    @classmethod
    def relative(cls, mean: float, share: float, sigmas: float = 3.0, low: float = -math.inf, high: float = math.inf) -> Distribution:
        """A normal of sd `share * mean`, cut at `sigmas` and at hard bounds."""
        sd = abs(mean) * share
        return cls("normal", mean, sd, max(low, mean - sigmas * sd), min(high, mean + sigmas * sd))

    def quantile(self, u: np.ndarray) -> np.ndarray:
        if self.kind == "fixed":
            return np.full(np.shape(u), self.mean)
        if self.kind == "uniform":
            return self.low + np.asarray(u) * (self.high - self.low)
        return np.clip(self.mean + self.sd * inverse_np(u), self.low, self.high)

    def quantile_column(self, u: Column, z: Column | None = None) -> Column:
        """Of u in (0, 1); z, if given, is the unit normal's quantile of it."""
        if self.kind == "fixed":
            return F.when(u.isNotNull(), F.lit(self.mean))
        if self.kind == "uniform":
            return self.low + u * (self.high - self.low)
        return F.greatest(F.lit(self.low), F.least(F.lit(self.high), self.mean + self.sd * (inverse_cdf(u) if z is None else z)))

    def cdf_column(self, x: Column) -> Column:
        if self.kind == "fixed":
            return F.when(x >= self.mean, 1.0).when(x < self.mean, 0.0)
        inside = (x - self.low) / (self.high - self.low) if self.kind == "uniform" else cdf((x - self.mean) / self.sd)
        return F.when(x < self.low, 0.0).when(x > self.high, 1.0).otherwise(inside)

    @property
    def spread(self) -> float:
        """Standard deviation; of a uniform one its width over the root of 12."""
        return (self.high - self.low) / math.sqrt(12) if self.kind == "uniform" else self.sd

    def cdf(self, x: float) -> float:
        """The untruncated distribution inside the bounds, 0 below and 1 above."""
        if self.kind == "fixed":
            return float(x >= self.mean)
        if x < self.low:
            return 0.0
        if x > self.high:
            return 1.0
        return (x - self.low) / (self.high - self.low) if self.kind == "uniform" else 0.5 * math.erfc(-(x - self.mean) / (self.sd * math.sqrt(2)))


def log_likelihood(alt_error: Column, rate_error: Column, distance: Column, from_pressure: Column, interval_s: Column, alt_sigma: float = 10.0, rate_sigma: float = 2.0, distance_sigma: float = 8.0, drift: Column | None = None, drift_share: float = 0.0) -> Column:
    """Sum of Gaussian log densities of three channels; a null error adds nothing.
    Altitudes from pressure are four times less sure; a rate's sigma grows with its
    altitudes' over the interval, and the horizontal one with the drift."""
    log = lambda e, s: -0.5 * F.pow(e / s, 2) - F.log(s) - 0.5 * math.log(2 * math.pi)
    s_alt = F.when(from_pressure, alt_sigma * 4).otherwise(alt_sigma)
    s_rate = F.when(interval_s > 0, F.hypot(F.lit(rate_sigma), s_alt * math.sqrt(2) / interval_s)).otherwise(rate_sigma)
    s_dist = F.lit(distance_sigma) if drift is None else F.hypot(F.lit(distance_sigma), drift_share * drift)
    return sum((F.coalesce(log(e, s), F.lit(0.0)) for e, s in ((alt_error, s_alt), (rate_error, s_rate), (distance, s_dist))), F.lit(0.0))
