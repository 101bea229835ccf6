"""Confidence ellipses of landing points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gauss import ellipse_scale
from ..functions.geo import METRES_PER_DEGREE, metres_per_degree_lon, wrap180
from .ranges import matched


def _turn(degrees: Column, running_on: bool) -> Column:
    return degrees if running_on else wrap180(degrees)


#: Shares of the greater variance under which the lesser one is rounding, as of points on one line.
FLAT = 1e-13


def axes(see: Column, snn: Column, sen: Column, confidence: float) -> list[Column]:
    """Semi axes and azimuth of covariances, no axis under a centimetre."""
    half = (see + snn) / 2
    root = F.sqrt(F.greatest(F.lit(0.0), half * half - (see * snn - sen * sen)))
    scale, top = ellipse_scale(confidence), half + root
    major = F.greatest(scale * F.sqrt(top), F.lit(0.01))
    low = F.when(half - root > FLAT * top, half - root).otherwise(0.0)
    minor = F.greatest(scale * F.sqrt(low), F.lit(0.01))
    turned = F.when(F.abs(sen) > 1e-15, F.atan2(sen, top - see)).otherwise(F.when(top == see, math.pi / 2).otherwise(0.0))
    return [major.alias("semi_major_m"), minor.alias("semi_minor_m"), F.pmod(F.degrees(turned), F.lit(180.0)).alias("azimuth_deg")]


def centroid(points: DataFrame, by: list[str], lat: str = "lat", lon: str = "lon", running_on: bool = False) -> DataFrame:
    """Mean latitude, and mean longitude about one of the group's own, so that the antimeridian does not split it.

    Longitudes that run on (past 180 degrees, as along a track) are taken as they are."""
    some = points.groupBy(*by).agg(F.min(lon).alias("__ref"))
    return matched(points, some, by).groupBy(*by).agg(F.avg(lat).alias("centre_lat"), _turn(F.first("__ref") + F.avg(_turn(F.col(lon) - F.col("__ref"), running_on)), running_on).alias("centre_lon"), F.count("*").alias("n"))


def fit(points: DataFrame, by: list[str], confidence: float = 0.95, lat: str = "lat", lon: str = "lon", running_on: bool = False) -> DataFrame:
    """by, centre_lat, centre_lon, n, semi axes, azimuth, confidence; groups of at
    least three points with both coordinates.  `running_on` is `centroid`'s."""
    whole = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    centres = centroid(whole, by, lat, lon, running_on).where("n >= 3")
    east = _turn(F.col(lon) - F.col("centre_lon"), running_on) * metres_per_degree_lon(F.col("centre_lat"))
    north = (F.col(lat) - F.col("centre_lat")) * METRES_PER_DEGREE
    flat = matched(whole, centres, by).withColumn("__e", east).withColumn("__n", north)
    cov = flat.groupBy(*by, "centre_lat", "centre_lon", "n").agg(F.var_samp("__e").alias("ee"), F.var_samp("__n").alias("nn"), F.covar_samp("__e", "__n").alias("en"))
    return cov.select(*by, "centre_lat", "centre_lon", "n", *axes(F.col("ee"), F.col("nn"), F.col("en"), confidence), F.lit(confidence).alias("confidence"))


def contains(lat: Column, lon: Column) -> Column:
    """Whether a point lies in the ellipse of the same row."""
    east = wrap180(lon - F.col("centre_lon")) * metres_per_degree_lon(F.col("centre_lat"))
    north, a = (lat - F.col("centre_lat")) * METRES_PER_DEGREE, F.radians("azimuth_deg")
    u = (east * F.sin(a) + north * F.cos(a)) / F.col("semi_major_m")
    v = (east * F.cos(a) - north * F.sin(a)) / F.col("semi_minor_m")
    return u * u + v * v <= 1


def containment(points: DataFrame, ellipses: DataFrame, by: list[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Share of each group's points in its ellipse."""
    return matched(points, ellipses, by).groupBy(*by, "confidence").agg(F.avg(contains(F.col(lat), F.col(lon)).cast("double")).alias("contained"))


def area_m2() -> Column:
    return math.pi * F.col("semi_major_m") * F.col("semi_minor_m")


def aspect() -> Column:
    return F.col("semi_major_m") / F.col("semi_minor_m")


def ring(steps: int = 72, running_on: bool = False) -> Column:
    """Closed ring of (lon, lat) structs of an ellipse row, `steps` + 1 vertices."""

    def vertex(k: Column) -> Column:
        t, a = k * (2 * math.pi / steps), F.radians("azimuth_deg")
        u, v = F.col("semi_major_m") * F.cos(t), F.col("semi_minor_m") * F.sin(t)
        east, north = u * F.sin(a) + v * F.cos(a), u * F.cos(a) - v * F.sin(a)
        return F.struct(_turn(F.col("centre_lon") + east / metres_per_degree_lon(F.col("centre_lat")), running_on).alias("lon"), (F.col("centre_lat") + north / METRES_PER_DEGREE).alias("lat"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: vertex(F.when(k == steps, 0).otherwise(k)))
