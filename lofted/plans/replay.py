"""Replay of a flight's log: estimate, re-predict the landing now and then, and score.

The estimate runs once, filter by filter; the updates at which a new prediction
is due are chosen from its rows, and the members of all of these predictions
fly together as one distributed ensemble.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import atmos, geo
from ..functions.gauss import inverse_cdf
from ..operators import ellipse, quality, sample, series
from ..operators.ranges import matched
from . import bank
from .sim import PARAMETERS, Config, Settings, simulate

# Least relative sigma, sigmas in a band of 5 to 95 %, sigma of the wind, metres above ground that count as landed, cut of a spread.
LEAST_SHARE, BAND_SIGMAS, WIND_SIGMA, LANDED_M, CUT = 0.01, 3.29, 0.20, 50.0, 3.0
LEVELS = (0.5, 0.95)
SCORED = 0.95


def spread(median: Column, low: Column, high: Column) -> Column:
    """Relative sigma of a parameter from its band."""
    return F.greatest(F.when(F.abs(median) > 0, (high - low) / BAND_SIGMAS / F.abs(median)).otherwise(LEAST_SHARE), F.lit(LEAST_SHARE))


def due_updates(updates: DataFrame, by: list[str], gap_s: float, ground_m: float) -> DataFrame:
    """The updates (by, s, alt_m, and burst: whether it was detected since the one
    before) at which the landing is predicted anew: `gap_s` after the last one, at the
    burst, and at the last update; never at ground level.  A due update without an
    altitude waits for the next that has one, as there is nothing to begin from."""
    ends = updates.groupBy(*by).agg(F.max("s").alias("__end"))
    marked = matched(updates, ends, by).withColumn("__force", F.coalesce(F.col("burst"), F.lit(False)) | (F.col("s") == F.col("__end")))
    airborne = marked.where(F.col("alt_m") > ground_m + LANDED_M)
    return series.throttle(airborne, by, "s", gap_s, F.col("__force"))


def members_around(posteriors: DataFrame, config: Config, members: int, seed: int) -> DataFrame:
    """Members (flight, ordinal, member, the parameters) drawn about each row of
    posteriors: flight, ordinal, and q05, q50, q95 of each parameter as <name>_<q>."""
    u = sample.designs(posteriors, ["flight", "ordinal"], members, len(PARAMETERS), F.lit(seed).cast("long") + F.col("ordinal"))
    u = u.withColumn("z", F.greatest(F.lit(-CUT), F.least(F.lit(CUT), inverse_cdf(F.col("u")))))
    wide = u.groupBy("flight", "ordinal", "member").pivot("dim", list(range(len(PARAMETERS)))).agg(F.first("z"))
    joined = wide.join(posteriors, ["flight", "ordinal"])

    def drawn(k: int, name: str) -> Column:
        z = F.col(str(k))
        if name == "wind_scale":
            return 1 + WIND_SIGMA * z
        m = F.col(f"{name}_q50")
        return m + F.abs(m) * spread(m, F.col(f"{name}_q05"), F.col(f"{name}_q95")) * z

    return joined.select("*", *[drawn(k, name).alias(name) for k, name in enumerate(PARAMETERS)])


def measured_state(posteriors: DataFrame, config: Config) -> DataFrame:
    """`posteriors` (lat, lon, alt_m, next_rate, burst_seen and the medians) with the
    columns of a state to fly on from: the place as measured, the filters' rate, and
    the diameter that the median's gas has there, or the median's at its burst."""
    gas = atmos.gas_mass(F.lit(config.dry_kg), F.col("free_lift_kg_q50"), F.lit(config.launch[2]), config.gas)
    rising = atmos.diameter(atmos.volume_at(gas, F.col("alt_m"), config.gas))
    return posteriors.select(
        "*", F.col("lat").alias("start_lat"), F.col("lon").alias("start_lon"), F.col("alt_m").alias("start_alt_m"), F.col("next_rate").alias("start_vz_ms"),
        F.when(F.col("burst_seen"), F.col("burst_diameter_m_q50")).otherwise(rising).alias("start_diameter_m"),
        F.when(F.col("burst_seen"), "DESCENT").otherwise("ASCENT").alias("start_phase"),
    )


def run(log: DataFrame, config: Config, settings: Settings, filters: int = 16, particles: int = 125, seed: int = 1, every: int = 1, gap_s: float = 50.0, members: int = 200) -> dict[str, DataFrame]:
    """Replays the log of one flight (s, lat, lon, alt_m and what `bank.run_filters` takes).

    Returns `burst` (a row if one was detected), `estimates` (bands per update),
    `updates` (diagnostics), `landings` (the members of each prediction) and
    `ellipses` (flight, ordinal, s, confidence and the fitted ellipse).
    """
    flight = F.col("flight").cast("string") if "flight" in log.columns else F.lit("")
    log = log.where("s is not null").withColumn("flight", flight)
    if log.select("flight").distinct().limit(2).count() > 1:
        raise ValueError("a replay is of one flight")
    burst = series.detect_burst(log, ["flight"], ["s"], "alt_m", "s")
    found = burst.agg(F.min("detected_s").alias("s")).first().s
    particles_of = bank.run_filters(log, config, settings, filters, particles, seed, every, found).persist()
    estimates, updates = bank.bands(particles_of), bank.diagnostics(particles_of)
    samples = log.groupBy("flight", "s").agg(*[F.first(c).alias(c) for c in ("lat", "lon", "alt_m")])
    seen = F.lit(False) if found is None else F.coalesce(F.lead("s").over(series.window(["flight"], "s")) > found, F.lit(True)) | (F.col("s") >= found)
    told = updates.join(samples, ["flight", "s"]).withColumn("burst_seen", seen)
    told = told.withColumn("burst", F.col("burst_seen") & ~F.coalesce(F.lag("burst_seen").over(series.window(["flight"], "s")), F.lit(False)))
    fired = due_updates(told, ["flight"], gap_s, settings.ground_m).withColumn("ordinal", F.row_number().over(series.window(["flight"], "fired_s")).cast("long") - 1)
    wide = estimates.groupBy("flight", "s").pivot("param", list(bank.ESTIMATED)).agg(*[F.first(q).alias(q) for q in ("q05", "q50", "q95")])
    posteriors = fired.select("flight", F.col("fired_s").alias("s"), "ordinal").join(told, ["flight", "s"]).join(wide, ["flight", "s"])
    drawn = members_around(measured_state(posteriors, config), config, members, seed).repartition(log.sparkSession.sparkContext.defaultParallelism)
    landings = simulate(drawn, config, settings, ("flight", "ordinal", "s", "member")).persist()
    ok = landings.where("status = 'OK'")
    fitted = [ellipse.fit(ok, ["flight", "ordinal", "s"], level) for level in LEVELS]
    return {"burst": burst, "estimates": estimates, "updates": updates, "landings": landings, "ellipses": fitted[0].unionByName(fitted[1])}


def score(updates: DataFrame, frozen: DataFrame, actual: DataFrame, by: list[str]) -> DataFrame:
    """Errors of live predictions against the one frozen before the flight.

    updates: by, s, centre_lat, centre_lon, semi_major_m, confidence, burst_s;
    frozen: by, centre_lat, centre_lon, confidence; actual: by, lat, lon.  Returns
    by, s, frozen_error_m, error_m, semi_major_m, after_burst, inside and
    reduction, of ellipses of the scored confidence; a group without a frozen one
    has no rows.
    """
    first = frozen.where(F.col("confidence") == SCORED).select(*by, F.col("centre_lat").alias("__lat"), F.col("centre_lon").alias("__lon"))
    joined = matched(matched(updates.where(F.col("confidence") == SCORED), first, by), actual.select(*by, "lat", "lon"), by)
    joined = joined.withColumn("frozen_error_m", geo.haversine(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon"))).withColumn("error_m", geo.haversine(F.col("centre_lat"), F.col("centre_lon"), F.col("lat"), F.col("lon")))
    return joined.select(*by, "s", "frozen_error_m", "error_m", "semi_major_m", F.coalesce(F.col("s") >= F.col("burst_s"), F.lit(False)).alias("after_burst"), (F.col("error_m") <= F.col("semi_major_m")).alias("inside"), quality.error_reduction(F.col("frozen_error_m"), F.col("error_m")).alias("reduction"))


def moments(scored: DataFrame, by: list[str], fraction: float = 0.5) -> DataFrame:
    """Per group the error at the first update after the burst, at the one nearest
    to a fraction of the last one's time (the earlier of equal ones), and at the last."""
    ends = scored.groupBy(*by).agg(F.max("s").alias("__end"))
    joined = matched(scored, ends, by)
    return joined.groupBy(*by).agg(
        F.min_by(F.when(F.col("after_burst"), F.col("error_m")), F.when(F.col("after_burst"), F.col("s"))).alias("at_burst_m"),
        F.min_by("error_m", F.struct(F.abs(F.col("s") - F.col("__end") * fraction), F.col("s"))).alias("at_fraction_m"),
        F.max_by("error_m", "s").alias("last_m"),
        F.first("frozen_error_m").alias("frozen_error_m"),
    )
