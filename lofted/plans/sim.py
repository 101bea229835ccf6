"""Flight simulation: one NumPy lane per member, batches by mapInPandas."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import atmos
from ..functions.constants import AIR_CONSTANT, CEILING_M, FLOOR_M, LAYERS, POTENTIAL_RADIUS_M, STANDARD_GRAVITY
from ..functions.gauss import Distribution
from ..functions.geo import METRES_PER_DEGREE
from ..operators import quality, sample

LAT, LON, ALT, VZ = range(4)
ASCENT, DESCENT, LANDED = 0, 1, 2
PARAMETERS = ("free_lift_kg", "ascent_cd", "burst_diameter_m", "chute_cd", "wind_scale")


class ConvergenceError(RuntimeError):
    exit_code = 5


@dataclass(frozen=True)
class Wind:
    """Levels of geopotential height with east and north wind; no levels is calm."""

    height: tuple[float, ...] = ()
    east: tuple[float, ...] = ()
    north: tuple[float, ...] = ()

    def at(self, h: np.ndarray) -> tuple[np.ndarray | float, np.ndarray | float]:
        """East and north wind at geopotential heights, held outside the levels."""
        if len(self.height) < 2:
            return (self.east[0], self.north[0]) if self.height else (0.0, 0.0)
        return np.interp(h, self.height, self.east), np.interp(h, self.height, self.north)

    def outside(self, low: float, high: float) -> bool:
        """Whether some height between these is beyond the levels; a constant wind has no end."""
        return len(self.height) > 1 and (low < self.height[0] or high > self.height[-1])


def constant_wind(east: float, north: float) -> Wind:
    return Wind((0.0,), (east,), (north,))


@dataclass(frozen=True)
class Config:
    payload_mass_kg: float = 1.2
    envelope_mass_kg: float = 1.2
    free_lift_kg: float = 1.1
    ascent_cd: float = 0.45
    burst_diameter_m: float = 7.0
    chute_area_m2: float = 1.0
    chute_cd: float = 1.4
    gas: str = "HELIUM"
    launch: tuple[float, float, float] = (23.2599, 77.4126, 500.0)

    @property
    def dry_kg(self) -> float:
        return self.payload_mass_kg + self.envelope_mass_kg

    def dispersion(self) -> list[tuple[str, Distribution]]:
        """Default spread of the five parameters before a flight."""
        d = Distribution.relative
        return [("free_lift_kg", d(self.free_lift_kg, 0.15)), ("ascent_cd", d(self.ascent_cd, 0.20, 3, 0.1, 2.0)), ("burst_diameter_m", d(self.burst_diameter_m, 0.10)), ("chute_cd", d(self.chute_cd, 0.15, 3, 0.1, 2.0)), ("wind_scale", d(1.0, 0.20))]


@dataclass(frozen=True)
class Settings:
    step_s: float = 0.25
    integrator: str = "RK4"
    t_end_s: float = 21_600.0
    stride: int = 10
    ground_m: float = 500.0
    wind: Wind = field(default_factory=lambda: constant_wind(12.0, -4.0))

    def __post_init__(self):
        if self.step_s <= 0 or self.t_end_s <= 0 or self.stride < 1 or self.integrator not in _TABLEAUS:
            raise ValueError("settings out of range")


# Butcher tableaus (stage rows, weights) and the limits of stability on the negative real axis.
_TABLEAUS = {
    "RK4": (((), (1 / 2,), (0, 1 / 2), (0, 0, 1)), (1 / 6, 1 / 3, 1 / 3, 1 / 6), 2.785),
    "RKF45": (((), (1 / 4,), (3 / 32, 9 / 32), (1932 / 2197, -7200 / 2197, 7296 / 2197), (439 / 216, -8, 3680 / 513, -845 / 4104), (-8 / 27, 2, -3544 / 2565, 1859 / 4104, -11 / 40)), (16 / 135, 0, 6656 / 12825, 28561 / 56430, -9 / 50, 2 / 55), 3.0),
}


#: Base heights of the layers; of each the pressure over the temperature there, its lapse, and the power of the law.
_H0 = [layer[0] for layer in LAYERS]
_TOP = [*_H0[1:], math.inf]
_Q0 = [p / layer[1] for p, layer in zip(atmos.BASE_PA, LAYERS)]
_SLOPE = [lapse / t0 if lapse else -STANDARD_GRAVITY / AIR_CONSTANT / t0 for _, t0, lapse in LAYERS]
_POWER = [-(STANDARD_GRAVITY / AIR_CONSTANT / lapse + 1) if lapse else 0.0 for _, _, lapse in LAYERS]
_LOWEST, _HIGHEST = (POTENTIAL_RADIUS_M * z / (POTENTIAL_RADIUS_M + z) for z in (FLOOR_M, CEILING_M))
_ARRAYS = tuple(np.array(x) for x in (_H0, _Q0, _SLOPE, _POWER))
_TIME_EPSILON, _RADIAN = 1e-9, math.pi / 180


def _in_layer(z: np.ndarray, e: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(pressure / temperature) ** e at altitudes that are all in layer k, and their geopotential heights."""
    h = POTENTIAL_RADIUS_M * z / (POTENTIAL_RADIUS_M + z)
    x = (h - _H0[k]) * _SLOPE[k]
    return _Q0[k] ** e * (np.exp(e * x) if _POWER[k] == 0 else (1 + x) ** (e * _POWER[k])), h


def _thinness(z: np.ndarray, e: float) -> tuple[np.ndarray, np.ndarray]:
    """As `_in_layer`, each altitude by its own layer; NaN outside the model."""
    h = POTENTIAL_RADIUS_M * z / (POTENTIAL_RADIUS_M + z)
    with np.errstate(invalid="ignore"):
        inside = (h >= _LOWEST) & (h <= _HIGHEST)
        at = np.where(inside, h, 0.0)
        layer = np.maximum(np.searchsorted(_ARRAYS[0], at, "right") - 1, 0)
        h0, q0, slope, power = (a[layer] for a in _ARRAYS)
        x = slope * (at - h0)
        out = q0**e * np.where(power == 0, np.exp(e * np.where(power == 0, x, 0.0)), (1 + np.where(power == 0, 0.0, x)) ** (e * power))
        return np.where(inside, out, np.nan), h


def _layer(low: float, high: float) -> int | None:
    """The layer that holds all heights between these, or None."""
    k = max(bisect_right(_H0, low) - 1, 0)
    return k if low >= _LOWEST and high < _TOP[k] and high <= _HIGHEST else None


class Lanes:
    """States of many members; each has its own time, and no member waits for another.

    Buoyancy does not change with height, as density times volume does not, and
    the drag of a sealed balloon goes with the cube root of pressure over
    temperature: one power a stage gives both.
    """

    def __init__(self, config: Config, settings: Settings, theta: dict[str, np.ndarray], state: np.ndarray | None = None, phase: np.ndarray | int = ASCENT, diameter: np.ndarray | None = None):
        self.config, self.settings = config, settings
        self.theta = {k: np.asarray(v, float) for k, v in theta.items()}
        n = len(self.theta["free_lift_kg"])
        lat, lon, alt = config.launch
        self.y = np.tile([[lat], [lon], [alt], [0.0]], (1, n)) if state is None else np.array(state, float)
        self.phase, self.failed, self.t = np.full(n, phase), np.zeros(n, bool), np.zeros(n)
        self.burst = np.full((n, 2), np.nan)
        self.steps, self.held = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.gas = self.gas_for(self.theta["free_lift_kg"])
        if diameter is not None:  # sealed before: what fills the balloon where it is
            q, _ = _thinness(self.y[ALT], 1.0)
            self.gas = np.where(self.phase == ASCENT, math.pi / 6 * np.asarray(diameter, float) ** 3 * q / atmos.gas_constant(config.gas), self.gas)

    def gas_for(self, free_lift: np.ndarray) -> np.ndarray:
        """Gas sealed in at launch for a free lift."""
        t, p, rho = (float(x[0]) for x in atmos.state_np(np.array([self.config.launch[2]])))
        rho_gas = p / (atmos.gas_constant(self.config.gas) * t)
        return (self.config.dry_kg + free_lift) / (rho - rho_gas) * rho_gas

    def diameter(self, lane: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Of the balloon while it rises, and at its burst after that."""
        q, _ = _thinness(self.y[ALT, lane], 1.0)
        whole = np.cbrt(6 * self.gas[lane] * atmos.gas_constant(self.config.gas) / (math.pi * q))
        return np.where(self.phase[lane] == ASCENT, whole, self.theta["burst_diameter_m"][lane])

    def _fly(self, which: int, stop: np.ndarray, record: Callable | None = None) -> None:
        """Moves the lanes of one phase to their stop times, or to the end of the phase."""
        c, s = self.config, self.settings
        rows, weights, limit = _TABLEAUS[s.integrator]
        stages, ends = [[(i, a) for i, a in enumerate(row) if a] for row in rows], [(i, w) for i, w in enumerate(weights) if w]
        lane = np.flatnonzero((self.phase == which) & ~self.failed & (stop - self.t > _TIME_EPSILON))
        rise, e, calm = which == ASCENT, 1 / 3 if which == ASCENT else 1.0, len(s.wind.height) < 2
        while len(lane):
            y, start, stop_at = self.y[:, lane].copy(), self.t[lane], stop[lane]
            scale, gas = self.theta["wind_scale"][lane], self.gas[lane] * atmos.gas_constant(c.gas)
            if rise:
                mass = c.dry_kg + self.gas[lane]
                push = STANDARD_GRAVITY * (gas / AIR_CONSTANT / mass - 1)
                drag = 0.5 * self.theta["ascent_cd"][lane] * (math.pi / 4) * (6 * gas / math.pi) ** (2 / 3) / AIR_CONSTANT / mass
                thin = np.cbrt(6 * gas / math.pi) / self.theta["burst_diameter_m"][lane]  # where the balloon bursts
            else:
                push = -STANDARD_GRAVITY
                drag = 0.5 * self.theta["chute_cd"][lane] * c.chute_area_m2 / AIR_CONSTANT / c.dry_kg
            if calm:
                east, north = s.wind.at(y[ALT])
                north, east = north * scale / METRES_PER_DEGREE, east * scale / METRES_PER_DEGREE
            steps, held, t = 0, np.zeros(len(lane), np.int64), start
            whole = int(((stop_at - start).min() + _TIME_EPSILON) / s.step_s)  # steps that no lane's end cuts
            margin = 100 + 500 * s.step_s  # more than a step moves a lane
            q, height = _thinness(y[ALT], e)
            while True:
                h = s.step_s if steps < whole else np.minimum(s.step_s, stop_at - t)
                low, high = height.min() - margin, height.max() + margin
                layer, near_end = _layer(low, high), s.wind.outside(low, high)
                ks: list[np.ndarray] = []
                beyond = None
                for stage in stages:
                    if stage:
                        i, a = stage[0]
                        moved = (h * a) * ks[i]
                        for i, a in stage[1:]:
                            moved += (h * a) * ks[i]
                        at = y + moved
                        q, height = _thinness(at[ALT], e) if layer is None else _in_layer(at[ALT], e, layer)
                    else:
                        at = y
                    if not calm:
                        east, north = s.wind.at(height)
                        north, east = north * scale / METRES_PER_DEGREE, east * scale / METRES_PER_DEGREE
                        if near_end:
                            out = (height < s.wind.height[0]) | (height > s.wind.height[-1])
                            beyond = out if beyond is None else beyond | out
                    k, v = np.empty_like(y), at[VZ]
                    k[LAT] = north
                    k[LON] = east / np.cos(at[LAT] * _RADIAN)
                    k[ALT] = v
                    rate = drag * q * np.abs(v)
                    k[VZ] = push - rate * v
                    if not ks:
                        damping = 2 * rate * h
                    ks.append(k)
                i, w = ends[0]
                moved = (h * w) * ks[i]
                for i, w in ends[1:]:
                    moved += (h * w) * ks[i]
                new = y + moved
                q, height = _thinness(new[ALT], e) if layer is None else _in_layer(new[ALT], e, layer)
                over = q <= thin if rise else new[ALT] <= s.ground_m
                if beyond is not None:
                    held += beyond
                before, y, was, steps = y, new, t, steps + 1
                t = start + steps * s.step_s if steps <= whole else t + h
                bad = not (damping.max() <= limit and np.isfinite((q + new[VZ]).sum()))
                if record is not None:
                    record(lane, t, y, over, steps, beyond)
                if bad or steps >= whole or over.any():
                    wrong = ~(damping <= limit) | ~np.isfinite(q + new[VZ])
                    over &= ~wrong
                    done = wrong | over | (stop_at - t <= _TIME_EPSILON)
                    if done.any():
                        bad = wrong
                        break
            self.y[:, lane], self.t[lane] = y, t
            self.steps[lane] += steps
            self.held[lane] += held
            if bad.any():
                self.y[:, lane[bad]], self.t[lane[bad]] = before[:, bad], was[bad]
                self.failed[lane[bad]] = True
            if over.any():
                gone = lane[over]
                if rise:
                    self.phase[gone] = DESCENT
                    self.burst[gone] = np.stack([t[over], y[ALT, over]], axis=1)
                else:
                    span = before[ALT, over] - y[ALT, over]
                    share = np.clip(np.where(span > 1e-6, (before[ALT, over] - s.ground_m) / np.where(span > 1e-6, span, 1), 1.0), 0, 1)
                    self.y[:, gone] = before[:, over] + share * (y[:, over] - before[:, over])
                    self.y[ALT, gone] = s.ground_m
                    self.t[gone] = was[over] + share * (t[over] - was[over])
                    self.phase[gone] = LANDED
            lane = lane[~done]

    def advance_to(self, stop: float | np.ndarray, record: Callable | None = None) -> None:
        """All lanes to a time, through their bursts."""
        stop = np.broadcast_to(np.asarray(stop, float), self.t.shape)
        self._fly(ASCENT, stop, record)
        self._fly(DESCENT, stop, record)

    def land(self, record: Callable | None = None) -> None:
        self.advance_to(self.settings.t_end_s, record)


_RESULT = ", ".join(f"{p} double" for p in PARAMETERS) + ", lat double, lon double, alt_m double, vz_ms double, landing_s double, burst_s double, burst_alt_m double, steps long, wind_held long, status string"
#: Columns of a state to begin from, of members that are in the air already.
START = ("start_lat", "start_lon", "start_alt_m", "start_vz_ms", "start_diameter_m", "start_phase")


def simulate(members: DataFrame, config: Config, settings: Settings, keys: tuple[str, ...] = ("member",)) -> DataFrame:
    """A row per member of (keys, the five parameters): landing, burst, steps, those
    with wind held beyond its levels, and status (OK, FAILED for an unstable or
    impossible flight, ALOFT if it has not landed).  Members with the columns of
    START go on from there, in ASCENT or DESCENT; others are launched."""
    resumed = set(START) <= set(members.columns)
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            more = {}
            if resumed:
                more = {"state": pdf[list(START[:4])].to_numpy(float).T, "phase": np.where(pdf.start_phase == "ASCENT", ASCENT, DESCENT), "diameter": pdf.start_diameter_m.to_numpy(float)}
            lanes = Lanes(config, settings, {p: pdf[p].to_numpy() for p in PARAMETERS}, **more)
            lanes.land()
            status = np.where(lanes.failed, "FAILED", np.where(lanes.phase == LANDED, "OK", "ALOFT"))
            ok = status == "OK"
            cut = lambda x: np.where(ok, x, np.nan)
            lon = (lanes.y[LON] + 180) % 360 - 180
            yield pdf[[*keys, *PARAMETERS]].assign(lat=cut(lanes.y[LAT]), lon=cut(lon), alt_m=cut(lanes.y[ALT]), vz_ms=cut(lanes.y[VZ]), landing_s=cut(lanes.t), burst_s=lanes.burst[:, 0], burst_alt_m=lanes.burst[:, 1], steps=lanes.steps, wind_held=lanes.held, status=status)

    picked = members.select(*keys, *PARAMETERS, *(START if resumed else ()))
    out = picked.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + _RESULT)
    return out.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in out.dtypes])


def ensemble(spark: SparkSession, n: int, seed: int, config: Config, settings: Settings) -> DataFrame:
    """A Latin-hypercube ensemble; rows do not depend on the number of partitions.
    Lanes of one task share each step's cost, so there is a task for each core."""
    members = sample.design(spark, n, config.dispersion(), seed).where("member is not null")
    return simulate(members.repartition(spark.sparkContext.defaultParallelism), config, settings)


def check_budget(result: DataFrame) -> None:
    """Raises if more members failed than the budget allows."""
    r = result.agg(F.count("*").alias("n"), F.count_if(F.col("status") != "OK").alias("bad")).first()
    if r.bad > quality.failure_budget(r.n):
        raise ConvergenceError(f"{r.bad} of {r.n} members failed")


def nominal(config: Config, theta: dict[str, float] | None = None) -> dict[str, np.ndarray]:
    """The parameters of one lane: the configuration's own but for those given."""
    return {p: np.array([float(v)]) for p, v in {**{p: getattr(config, p, 1.0) for p in PARAMETERS}, **(theta or {})}.items()}


def trajectory(config: Config, settings: Settings, theta: dict[str, float] | None = None, every: int | None = None) -> pd.DataFrame:
    """One flight's states every `every` steps, with the burst and the landing; raises
    where the flight fails or does not come down."""
    lanes, rows = Lanes(config, settings, nominal(config, theta)), []
    stride, count = every or settings.stride, 0

    def add(t, y, phase: str, diameter: float, held: bool) -> None:
        rows.append((float(t), float(y[LAT]), float((y[LON] + 180) % 360 - 180), float(y[ALT]), float(y[VZ]), diameter, phase, held))

    def size(z: float) -> float:
        q = float(_thinness(np.array([z]), 1.0)[0][0])
        return float(np.cbrt(6 * lanes.gas[0] * atmos.gas_constant(config.gas) / (math.pi * q)))

    def record(lane, t, y, over, steps, beyond) -> None:
        nonlocal count
        count += 1
        held = beyond is not None and bool(beyond[0])
        rising = lanes.phase[0] == ASCENT
        if over[0] and rising:
            add(t[0], y[:, 0], "BURST", size(y[ALT, 0]), held)
        elif not over[0] and count % stride == 0:
            add(t[0], y[:, 0], "ASCENT" if rising else "DESCENT", size(y[ALT, 0]) if rising else float(lanes.theta["burst_diameter_m"][0]), held)

    add(0.0, lanes.y[:, 0], "ASCENT", size(lanes.y[ALT, 0]), False)
    lanes.land(record)
    if lanes.failed[0] or lanes.phase[0] != LANDED:
        raise ConvergenceError("the flight failed" if lanes.failed[0] else f"the flight did not reach the ground within {settings.t_end_s} s")
    add(lanes.t[0], lanes.y[:, 0], "LANDED", float(lanes.theta["burst_diameter_m"][0]), False)
    return pd.DataFrame(rows, columns=["s", "lat", "lon", "alt_m", "vz_ms", "diameter_m", "phase", "wind_extrapolated"]).sort_values("s", kind="stable", ignore_index=True)


# The noise of synthetic telemetry.
@dataclass(frozen=True)
class Noise:
    horizontal_m: float = 8.0
    altitude_m: float = 10.0
    pressure_share: float = 0.002
    temperature_k: float = 1.0
    dropout_start: float = 0.004
    dropout_run: int = 3


def noisy_log(config: Config, settings: Settings, seed: int, every: int, theta: dict[str, float] | None = None, noise: Noise | None = None) -> pd.DataFrame:
    """A flight's telemetry: packet_id, s, lat, lon, alt_m (NaN in runs of dropouts),
    pressure_pa, temperature_k; a dropout that has begun runs on before another can."""
    noise, pdf = noise or Noise(), trajectory(config, settings, theta, every)
    rng, n = np.random.Generator(np.random.Philox(seed)), len(pdf)
    t, p, _ = atmos.state_np(pdf.alt_m.to_numpy())
    begins, dropped, left = rng.random(n) < noise.dropout_start, np.zeros(n, bool), 0
    for k in range(n):
        left = noise.dropout_run if left == 0 and begins[k] else left
        dropped[k], left = left > 0, max(left - 1, 0)
    draw = rng.standard_normal((5, n))
    lat, lon = pdf.lat.to_numpy(), pdf.lon.to_numpy()
    return pd.DataFrame({
        "packet_id": np.arange(n), "s": pdf.s,
        "lat": lat + noise.horizontal_m * draw[0] / METRES_PER_DEGREE,
        "lon": (lon + noise.horizontal_m * draw[1] / (METRES_PER_DEGREE * np.cos(np.radians(lat))) + 180) % 360 - 180,
        "alt_m": np.where(dropped, np.nan, pdf.alt_m + noise.altitude_m * draw[2]),
        "pressure_pa": p * (1 + noise.pressure_share * draw[3]), "temperature_k": t + noise.temperature_k * draw[4],
    })


def synthetic_log(spark: SparkSession, config: Config, settings: Settings, seed: int, every: int = 1, theta: dict[str, float] | None = None) -> DataFrame:
    """`noisy_log` as a DataFrame, NaN as null."""
    made = spark.createDataFrame(noisy_log(config, settings, seed, every, theta).drop(columns="temperature_k"))
    return made.withColumn("alt_m", F.nanvl("alt_m", F.lit(None).cast("double")))
