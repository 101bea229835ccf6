"""The evaluation set: flights whose truth is known, with noisy telemetry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sample
from .sim import PARAMETERS, Config, Noise, Settings, noisy_log, simulate

_LOG = "flight string, packet_id long, s double, lat double, lon double, alt_m double, pressure_pa double, temperature_k double"


def truths(seeds: DataFrame, config: Config, settings: Settings) -> DataFrame:
    """Truth of each flight of `seeds` (name, seed, launch_epoch_utc): one design
    covers the set, in the order of names, drawn with the first one's seed.  The
    list of flights is read by the driver, their logs are not."""
    listed = seeds.orderBy("name").select("name", F.col("seed").cast("long").alias("seed"), "launch_epoch_utc").collect()
    if not listed:
        raise ValueError("no flights to generate")
    spark = seeds.sparkSession
    design = sample.design(spark, len(listed), config.dispersion(), listed[0]["seed"])
    named = spark.createDataFrame([(k, r["name"], r["seed"]) for k, r in enumerate(listed)], "member long, name string, seed long")
    flown = simulate(design, config, settings)
    epochs = seeds.select("name", "launch_epoch_utc")
    return named.join(flown, "member").join(epochs, "name").select("name", "seed", "launch_epoch_utc", *PARAMETERS, F.col("burst_alt_m"), F.col("burst_s"), F.col("lat").alias("landing_lat"), F.col("lon").alias("landing_lon"), "landing_s", "status")


def telemetry(truth: DataFrame, config: Config, settings: Settings, noise: Noise | None = None, interval_s: float = 1.0) -> DataFrame:
    """Telemetry of each flight of `truths`, a task for each: flight, packet_id, s,
    epoch_utc (to the millisecond), lat, lon, alt_m (null in dropouts), pressure_pa
    and temperature_k."""
    every = max(1, round(interval_s / settings.step_s))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        made = noisy_log(config, settings, int(row.seed), every, {p: float(row[p]) for p in PARAMETERS}, noise)
        return made.assign(flight=row["name"])[[c.split(" ")[0] for c in _LOG.split(", ")]]

    rows = truth.select("name", "seed", *PARAMETERS).groupBy("name").applyInPandas(one, _LOG)
    epochs = truth.select(F.col("name").alias("flight"), "launch_epoch_utc")
    at = F.timestamp_micros(F.unix_micros(F.col("launch_epoch_utc").cast("timestamp")) + F.round(F.col("s") * 1000).cast("long") * 1000)
    return rows.join(epochs, "flight").select("flight", "packet_id", "s", at.alias("epoch_utc"), "lat", "lon", F.nanvl("alt_m", F.lit(None).cast("double")).alias("alt_m"), "pressure_pa", "temperature_k")
