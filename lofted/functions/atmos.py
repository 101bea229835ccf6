"""Atmosphere and balloon physics, as Column expressions and NumPy twins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import AIR_CONSTANT, CEILING_M, FLOOR_M, GAMMA, GAS_CONSTANT, GAS_MOLAR_MASS, LAYERS, POTENTIAL_RADIUS_M, SEA_LEVEL_PA, STANDARD_GRAVITY

_G_R = STANDARD_GRAVITY / AIR_CONSTANT


def _bases() -> tuple[float, ...]:
    out = [SEA_LEVEL_PA]
    for (h0, t0, lapse), (h1, _, _) in zip(LAYERS, LAYERS[1:]):
        dh = h1 - h0
        out.append(out[-1] * (math.exp(-_G_R * dh / t0) if lapse == 0 else (t0 / (t0 + lapse * dh)) ** (_G_R / lapse)))
    return tuple(out)


BASE_PA = _bases()


def geopotential(z: Column) -> Column:
    return POTENTIAL_RADIUS_M * z / (POTENTIAL_RADIUS_M + z)


def geometric(h: Column) -> Column:
    return POTENTIAL_RADIUS_M * h / (POTENTIAL_RADIUS_M - h)


def _by_layer(h: Column, value) -> Column:
    """value(layer) of the last layer whose base is not above h, of the first below all."""
    out = F.when(h >= LAYERS[-1][0], value(len(LAYERS) - 1))
    for k in range(len(LAYERS) - 2, 0, -1):
        out = out.when(h >= LAYERS[k][0], value(k))
    return out.otherwise(value(0))


def layer_index(h: Column) -> Column:
    return _by_layer(h, F.lit)


def _of_layer(k: Column, values) -> Column:
    """The value of layer k of a table by layer."""
    return F.get(F.array(*[F.lit(float(v)) for v in values]), k)


_BASE_M, _BASE_K, _BASE_LAPSE = zip(*LAYERS)


def _temperature(h: Column, k: Column) -> Column:
    return _of_layer(k, _BASE_K) + _of_layer(k, _BASE_LAPSE) * (h - _of_layer(k, _BASE_M))


def _pressure(h: Column, k: Column, t: Column) -> Column:
    t0, lapse = _of_layer(k, _BASE_K), _of_layer(k, _BASE_LAPSE)
    share = F.when(lapse == 0, F.exp(-_G_R * (h - _of_layer(k, _BASE_M)) / t0)).otherwise(F.pow(t0 / t, _G_R / lapse))
    return _of_layer(k, BASE_PA) * share


def with_state(df: DataFrame, z: Column) -> DataFrame:
    """`df` with temperature_k, pressure_pa, density_kg_m3 and sound_ms at altitude
    z; null outside -5 to 86 km.  The layer is found once and its values by index."""
    own = df.withColumn("__h", F.when(z.between(FLOOR_M, CEILING_M), geopotential(z))).withColumn("__k", F.when(F.col("__h").isNotNull(), layer_index(F.col("__h"))))
    own = own.withColumn("temperature_k", _temperature(F.col("__h"), F.col("__k"))).withColumn("pressure_pa", _pressure(F.col("__h"), F.col("__k"), F.col("temperature_k")))
    t, p = F.col("temperature_k"), F.col("pressure_pa")
    return own.withColumn("density_kg_m3", p / (AIR_CONSTANT * t)).withColumn("sound_ms", F.sqrt(GAMMA * AIR_CONSTANT * t)).drop("__h", "__k")


def temperature(z: Column) -> Column:
    h = geopotential(z)
    return F.when(z.between(FLOOR_M, CEILING_M), _temperature(h, layer_index(h)))


def pressure(z: Column) -> Column:
    """Pa at geometric altitude z; null outside -5 to 86 km."""
    h = geopotential(z)
    k = layer_index(h)
    return F.when(z.between(FLOOR_M, CEILING_M), _pressure(h, k, _temperature(h, k)))


def density(z: Column) -> Column:
    return pressure(z) / (AIR_CONSTANT * temperature(z))


def speed_of_sound(z: Column) -> Column:
    return F.sqrt(GAMMA * AIR_CONSTANT * temperature(z))


def pressure_altitude(p: Column) -> Column:
    """Geometric altitude of a pressure by its layer's inverse; null outside the model."""
    k = F.when(p > BASE_PA[1], 0)
    for i in range(1, len(LAYERS) - 1):
        k = k.when(p > BASE_PA[i + 1], i)
    k = k.otherwise(len(LAYERS) - 1)
    t0, lapse, share = _of_layer(k, _BASE_K), _of_layer(k, _BASE_LAPSE), p / _of_layer(k, BASE_PA)
    rise = F.when(lapse == 0, -t0 / _G_R * F.log(share)).otherwise(t0 / lapse * (F.pow(share, -lapse / _G_R) - 1))
    z = geometric(_of_layer(k, _BASE_M) + rise)
    return F.when((p > 0) & z.between(FLOOR_M - 1e-6, CEILING_M + 1e-6), z)


def exponential_density(z: Column, sea_level: float = 1.225, scale_m: float = 8500.0) -> Column:
    return sea_level * F.exp(-z / scale_m)


def state_np(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Temperature, pressure, density at altitudes; NaN outside the model."""
    z = np.where((z >= FLOOR_M) & (z <= CEILING_M), z, np.nan)
    h = POTENTIAL_RADIUS_M * z / (POTENTIAL_RADIUS_M + z)
    k = np.clip(np.searchsorted(_H0, np.nan_to_num(h), "right") - 1, 0, len(_H0) - 1)
    t0, lapse, dh = _T0[k], _LAPSE[k], h - _H0[k]
    t = t0 + lapse * dh
    iso = lapse == 0
    p = _P0[k] * np.where(iso, np.exp(-_G_R * dh / t0), (t0 / t) ** (_G_R / np.where(iso, 1.0, lapse)))
    return t, p, p / (AIR_CONSTANT * t)


_H0, _T0, _LAPSE, _P0 = (np.array(x) for x in (*zip(*LAYERS), BASE_PA))


def gas_constant(gas: str) -> float:
    return GAS_CONSTANT / GAS_MOLAR_MASS[gas]


def gas_density(p: Column, t: Column, gas: str) -> Column:
    return p / (gas_constant(gas) * t)


def inflated_volume(dry_kg: Column, lift_kg: Column, z: Column, gas: str) -> Column:
    """Volume at launch that lifts the dry mass and the free lift; null for gas that does not lift."""
    buoyant = density(z) - gas_density(pressure(z), temperature(z), gas)
    return F.when(buoyant > 0, (dry_kg + lift_kg) / buoyant)


def gas_mass(dry_kg: Column, lift_kg: Column, z: Column, gas: str) -> Column:
    return inflated_volume(dry_kg, lift_kg, z, gas) * gas_density(pressure(z), temperature(z), gas)


def volume_at(gas_kg: Column, z: Column, gas: str) -> Column:
    return gas_kg * gas_constant(gas) * temperature(z) / pressure(z)


def diameter(volume: Column) -> Column:
    return F.cbrt(6 * volume / math.pi)


def volume(diameter_m: Column) -> Column:
    return math.pi * F.pow(diameter_m, 3) / 6


def frontal_area(diameter_m: Column) -> Column:
    return math.pi * diameter_m * diameter_m / 4


def terminal_rate(mass: Column, rho: Column, cd: Column, area: Column) -> Column:
    return -F.sqrt(2 * mass * STANDARD_GRAVITY / (rho * cd * area))


def ascent_rate(lift_kg: Column, rho: Column, cd: Column, area: Column) -> Column:
    """Rate at which drag balances the free lift."""
    return F.sqrt(2 * lift_kg * STANDARD_GRAVITY / (rho * cd * area))
