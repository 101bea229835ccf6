"""The data of plots: one row per mark, in the units of the axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import atmos
from ..functions.geo import METRES_PER_DEGREE, bearing, haversine, metres_per_degree_lon, wrap180
from ..operators.ellipse import ring
from ..operators.ranges import matched


def altitude(states: DataFrame) -> DataFrame:
    """Altitude against time: member_index, minutes, km, and whether it is the burst."""
    return states.select("member_index", (F.col("s") / 60).alias("minutes"), (F.col("alt_m") / 1000).alias("km"), (F.col("phase") == "BURST").alias("is_burst"))


def footprint(points: DataFrame, centres: DataFrame, by: list[str]) -> DataFrame:
    """Points in kilometres east and north of the centre of their group."""
    east = wrap180(F.col("lon") - F.col("centre_lon")) * metres_per_degree_lon(F.col("centre_lat")) / 1000
    north = (F.col("lat") - F.col("centre_lat")) * METRES_PER_DEGREE / 1000
    return matched(points, centres.select(*by, "centre_lat", "centre_lon"), by).withColumns({"east_km": east, "north_km": north}).drop("centre_lat", "centre_lon")


def outlines(ellipses: DataFrame, by: list[str], steps: int = 72) -> DataFrame:
    """The rings of ellipses in kilometres about their centres: by, confidence, vertex, east_km, north_km."""
    corner = F.posexplode(ring(steps)).alias("vertex", "p")
    east = wrap180(F.col("p.lon") - F.col("centre_lon")) * metres_per_degree_lon(F.col("centre_lat")) / 1000
    north = (F.col("p.lat") - F.col("centre_lat")) * METRES_PER_DEGREE / 1000
    return ellipses.select(*by, "confidence", "centre_lat", "centre_lon", corner).select(*by, "confidence", "vertex", east.alias("east_km"), north.alias("north_km"))


def drift(centres: DataFrame, launches: DataFrame, by: list[str]) -> DataFrame:
    """Where each group's launch lies from its centre, in kilometres, and how far and
    on what bearing the balloon drifted: by, launch_east_km, launch_north_km, drift_km, bearing_deg."""
    told = matched(centres.select(*by, "centre_lat", "centre_lon"), launches.select(*by, "launch_lat", "launch_lon"), by)
    at = [F.col(c) for c in ("launch_lat", "launch_lon", "centre_lat", "centre_lon")]
    east = wrap180(at[1] - at[3]) * metres_per_degree_lon(at[2]) / 1000
    north = (at[0] - at[2]) * METRES_PER_DEGREE / 1000
    return told.select(*by, east.alias("launch_east_km"), north.alias("launch_north_km"), (haversine(*at) / 1000).alias("drift_km"), bearing(*at).alias("bearing_deg"))


def posterior(bands: DataFrame, truth: dict[str, float] | None = None) -> DataFrame:
    """A parameter's median and band against minutes, with the truth where it is known."""
    line = F.lit(None).cast("double")
    for name, value in (truth or {}).items():
        line = F.when(F.col("param") == name, F.lit(float(value))).otherwise(line)
    return bands.select("param", (F.col("s") / 60).alias("minutes"), F.col("q50").alias("median"), F.col("q05").alias("low"), F.col("q95").alias("high"), line.alias("truth"))


def error(scored: DataFrame, by: list[str]) -> DataFrame:
    """Errors in kilometres against minutes: frozen, live and claimed."""
    km = lambda c: F.col(c) / 1000
    return scored.select(*by, (F.col("s") / 60).alias("minutes"), km("frozen_error_m").alias("frozen_km"), km("error_m").alias("live_km"), km("semi_major_m").alias("claimed_km"), "after_burst")


def calibration(contained: DataFrame, by: list[str]) -> DataFrame:
    """Nominal against empirical containment, with what is between them."""
    return contained.select(*by, F.col("confidence").alias("nominal"), F.col("contained").alias("empirical"), (F.col("contained") - F.col("confidence")).alias("gap"))


def residual(reference: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """The atmosphere against a table (altitude_m, temperature_k, pressure_pa,
    density_kg_m3): altitude_m, quantity, percent off, and whether it is within tolerance."""
    names = ("temperature_k", "pressure_pa", "density_kg_m3")
    told = reference.select("altitude_m", *[F.col(n).alias("__" + n) for n in names])
    both = atmos.with_state(told, F.col("altitude_m"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("quantity"), ((F.col(n) - F.col("__" + n)) / F.col("__" + n)).alias("share")) for n in names])).alias("r")
    return both.select("altitude_m", rows).select("altitude_m", "r.quantity", (F.col("r.share") * 100).alias("percent"), (F.abs("r.share") <= tolerance).alias("within"))
