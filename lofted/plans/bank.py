"""A bank of particle filters: each filter one grouped task over a flight's log."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.gauss import inverse_np
from ..functions.geo import METRES_PER_DEGREE
from ..operators import weights
from .sim import ALT, ASCENT, LAT, LON, PARAMETERS, VZ, Config, ConvergenceError, Lanes, Settings

# The filter's settings, and the step between the seeds of a bank's filters.
SHRINK, ROUGHEN, RESAMPLE, SEED_STEP = 0.98, 0.02, 0.5, 7919
SIGMA_ALT, SIGMA_RATE, SIGMA_FLAT = 10.0, 2.0, 8.0
#: Widening of the altitude's sigma where it is by pressure, sigma of the wind's scale, least mass of a conditional redraw.
PRESSURE_FACTOR, SIGMA_WIND, LEAST_MASS = 4.0, 0.2, 1e-6
ESTIMATED = PARAMETERS[:4]
_ROWS = "flight string, filter_id long, update int, s double, particle int, " + ", ".join(f"{p} double" for p in PARAMETERS) + ", w double, mean_rate double, next_rate double, impossible int, resamples int"


def check_prior(config: Config, particles: int = 2, threshold: float = RESAMPLE, shrink: float = SHRINK, roughen: float = ROUGHEN) -> None:
    """Raises unless every estimated parameter has width and the settings are in range."""
    flat = [name for name, d in config.dispersion() if name in ESTIMATED and not d.high > d.low]
    if flat:
        raise ValueError(f"the prior of {', '.join(flat)} has no width")
    if particles < 2 or not 0 < threshold <= 1 or not 1 / 3 < shrink <= 1 or roughen < 0:
        raise ValueError("filter settings out of range")


def rates(pdf: pd.DataFrame) -> pd.DataFrame:
    """Samples in order of time with rate and span_s: the central difference of
    the neighbours' altitudes, one-sided at the ends; NaN where one has none."""
    s, alt = pdf.s.to_numpy(float), pdf.alt_m.to_numpy(float)
    k = np.arange(len(s))
    a, b = np.maximum(k - 1, 0), np.minimum(k + 1, len(s) - 1)
    span = np.where((s[b] > s[a]) & ~np.isnan(alt[a]) & ~np.isnan(alt[b]), s[b] - s[a], np.nan)
    return pdf.assign(rate=(alt[b] - alt[a]) / span, span_s=span)


def _metres(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Great-circle distance."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * METRES_PER_DEGREE * 180 / math.pi * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def log_likelihood(y: np.ndarray, row, launch: tuple[float, float, float]) -> np.ndarray:
    """Of states given a sample with its rate, less a constant; absent channels add nothing."""
    total = np.zeros(y.shape[1])
    sigma = SIGMA_ALT * (PRESSURE_FACTOR if row.by_pressure else 1.0)
    if not np.isnan(row.alt_m):
        total -= 0.5 * ((y[ALT] - row.alt_m) / sigma) ** 2 + np.log(sigma)
    if not np.isnan(row.rate):
        s_rate = np.hypot(SIGMA_RATE, sigma * np.sqrt(2) / row.span_s)
        total -= 0.5 * ((y[VZ] - row.rate) / s_rate) ** 2 + np.log(s_rate)
    if not (np.isnan(row.lat) or np.isnan(row.lon)):
        # wind is pinned, so the horizontal channel widens with the drift
        s_flat = np.hypot(SIGMA_FLAT, SIGMA_WIND * _metres(launch[0], launch[1], y[LAT], y[LON]))
        total -= 0.5 * (_metres(row.lat, row.lon, y[LAT], y[LON]) / s_flat) ** 2 + np.log(s_flat)
    return total


def semidefinite_root(a: np.ndarray) -> np.ndarray:
    """The lower triangular root of a covariance; a dimension without variance gets zeros."""
    out = np.zeros_like(a, float)
    for i in range(len(a)):
        rest = a[i:, i] - out[i:, :i] @ out[i, :i]
        if rest[0] > 0:
            out[i:, i] = rest / math.sqrt(rest[0])
    return out


class Filter:
    """Particles over the four estimated parameters; wind's scale is pinned."""

    def __init__(self, config: Config, settings: Settings, particles: int, seed: int):
        check_prior(config, particles)
        self.config, self.n, self.rng = config, particles, np.random.Generator(np.random.Philox(seed))
        self.prior = dict(config.dispersion())
        self.seen, self.resamples, self.impossible = False, 0, 0
        theta = {name: d.quantile(np.clip((self.rng.permutation(particles) + self.rng.random(particles)) / particles, 1e-12, 1 - 1e-12)) for name, d in self.prior.items()}
        theta["wind_scale"] = np.ones(particles)
        self.lanes, self.logw = Lanes(config, settings, theta), np.zeros(particles)
        self.w = np.full(particles, 1 / particles)

    def mean_rate(self) -> float:
        return float((self.w * self.lanes.y[VZ]).sum())

    def update(self, row) -> None:
        """Moves to a sample's time and weighs; raises when no particle can explain it."""
        self.lanes.advance_to(row.s)
        with np.errstate(invalid="ignore"):
            self.logw = self.logw + log_likelihood(self.lanes.y, row, self.config.launch)
        self.logw[self.lanes.failed | ~np.isfinite(self.logw)] = -np.inf
        self.impossible = int(self.lanes.failed.sum())
        if self.impossible == self.n:
            raise ConvergenceError(f"every particle was refuted by {row.s} s")
        top = self.logw.max()
        w = np.ones(self.n) if not np.isfinite(top) else np.exp(self.logw - top)
        self.w = w / w.sum()

    def resample(self) -> None:
        """Picks by weight, draws parameters to their mean with correlated noise, and,
        until a burst is seen, its diameter and the parachute's drag from the prior."""
        lanes, prior = self.lanes, self.prior
        x = np.stack([lanes.theta[p] for p in ESTIMATED])
        mean = x @ self.w
        centred = x - mean[:, None]
        floor = np.array([ROUGHEN * prior[p].spread for p in ESTIMATED])
        a = (3 * SHRINK - 1) / (2 * SHRINK)
        root = semidefinite_root((self.w * centred) @ centred.T + np.diag(floor**2)) * math.sqrt(max(0.0, 1 - a * a))
        places = (np.arange(self.n) + self.rng.random()) / self.n
        pick = np.minimum(np.searchsorted(np.cumsum(self.w), places), self.n - 1)
        new = a * x[:, pick] + (1 - a) * mean[:, None] + root @ self.rng.standard_normal((len(ESTIMATED), self.n))
        new = {p: np.clip(v, prior[p].low, prior[p].high) for p, v in zip(ESTIMATED, new)}
        if not self.seen:
            new["chute_cd"] = prior["chute_cd"].quantile(self.rng.random(self.n))
        old_lift = lanes.theta["free_lift_kg"][pick]
        lanes.y, lanes.t, lanes.burst, lanes.phase, lanes.failed = lanes.y[:, pick], lanes.t[pick], lanes.burst[pick], lanes.phase[pick], lanes.failed[pick]
        # the sealed gas follows the free lift
        lanes.gas = np.where(lanes.phase == ASCENT, lanes.gas[pick] * lanes.gas_for(new["free_lift_kg"]) / lanes.gas_for(old_lift), lanes.gas[pick])
        lanes.theta = {**{p: v[pick] for p, v in lanes.theta.items()}, **new}
        if not self.seen:
            d = prior["burst_diameter_m"]
            reached = np.where(lanes.phase == ASCENT, lanes.diameter(), d.low)
            low = np.minimum([d.cdf(float(v)) for v in reached], 1 - LEAST_MASS)
            u = np.clip(low + self.rng.random(self.n) * (1 - low), np.finfo(float).tiny, 1 - 2.0**-53)
            lanes.theta["burst_diameter_m"] = np.clip(d.mean + d.sd * inverse_np(u), d.low, d.high)
        self.logw, self.w = np.zeros(self.n), np.full(self.n, 1 / self.n)
        self.resamples += 1


def run_filters(log: DataFrame, config: Config, settings: Settings, filters: int = 16, particles: int = 125, seed: int = 1, every: int = 1, burst_s: float | None = None) -> DataFrame:
    """Particles of every filter and update, weighed and not yet resampled: flight,
    filter_id, update, s, particle, the parameters, w, mean_rate, next_rate (the
    mean after resampling), impossible and resamples.

    Samples have s, lat, lon and alt_m (null where there is none), may have a
    `flight`, and a true `by_pressure` marks altitudes of the barometer; rows
    without s are left out.  Each sample gives its neighbours rates; every
    `every`-th is an update.  A burst detected at burst_s is known from the update
    whose stretch of samples holds it.
    """
    by_pressure = F.coalesce(F.col("by_pressure"), F.lit(False)) if "by_pressure" in log.columns else F.lit(False)
    flight = F.col("flight").cast("string") if "flight" in log.columns else F.lit("")
    own = log.where("s is not null").select(flight.alias("flight"), "s", "lat", "lon", "alt_m", by_pressure.alias("by_pressure"))
    own = own.withColumn("filter_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(filters - 1).cast("long"))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = rates(pdf.sort_values("s", kind="stable").reset_index(drop=True))
        number, out = int(pdf.filter_id.iloc[0]), []
        f = Filter(config, settings, particles, seed + SEED_STEP * number)
        for k, i in enumerate(range(0, len(pdf), every)):
            row = next(pdf.iloc[i : i + 1].itertuples())
            f.seen = f.seen or (burst_s is not None and pdf.s.iloc[min(i + every, len(pdf)) - 1] >= burst_s)
            f.update(row)
            made = {"flight": pdf.flight.iloc[0], "filter_id": number, "update": k, "s": row.s, "particle": np.arange(particles), **{p: f.lanes.theta[p] for p in PARAMETERS}, "w": f.w, "mean_rate": f.mean_rate(), "impossible": f.impossible, "resamples": f.resamples}
            if 1 / (f.w * f.w).sum() < RESAMPLE * particles:
                f.resample()
            out.append(pd.DataFrame({**made, "next_rate": f.mean_rate()}))
        return pd.concat(out)[[c.split(" ")[0] for c in _ROWS.split(", ")]]

    return own.groupBy("flight", "filter_id").applyInPandas(one, _ROWS)


def bands(particles: DataFrame) -> DataFrame:
    """Pooled posterior of each flight's update and parameter: q05, q50, q95, ess;
    the filters' particles are an equal mixture."""
    by = ["flight", "update", "s", "param"]
    pooled = weights.pool(particles, ["flight", "update"], "filter_id")
    long = pooled.select("flight", "update", "s", "w", F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).alias("v")) for p in ESTIMATED])).alias("x")).select("flight", "update", "s", "w", "x.param", "x.v")
    ess = long.groupBy(*by).agg(weights.effective_size().alias("ess"))
    return weights.weighted_quantiles(long, by, "v", "w", parts=1).join(ess, by)


def diagnostics(particles: DataFrame) -> DataFrame:
    """Per flight and update, over the bank: the mean rates before and after
    resampling, impossible particles and resamples so far."""
    each = particles.groupBy("flight", "update", "s", "filter_id").agg(*[F.first(c).alias(c) for c in ("mean_rate", "next_rate", "impossible", "resamples")])
    return each.groupBy("flight", "update", "s").agg(F.avg("mean_rate").alias("mean_rate"), F.avg("next_rate").alias("next_rate"), F.sum("impossible").alias("impossible"), F.sum("resamples").alias("resamples"))


def run(log: DataFrame, config: Config, settings: Settings, filters: int = 16, particles: int = 125, seed: int = 1) -> DataFrame:
    """`bands` of a bank over a log, every sample an update."""
    return bands(run_filters(log, config, settings, filters, particles, seed)).drop("flight")
