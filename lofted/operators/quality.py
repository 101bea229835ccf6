"""Rules, rejects, idempotent ingest, identity, scoring and tolerance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INVERTED, DROPOUT, FROM_PRESSURE = 1, 2, 4


def split_by_rules(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with `reasons`; null counts as broken."""
    reasons = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    judged = df.withColumn("reasons", reasons)
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def balloon_rules() -> dict[str, Column]:
    positive = {c: F.col(c) > 0 for c in ("payload_mass_kg", "envelope_mass_kg", "free_lift_kg", "chute_area_m2", "launch_diameter_m")}
    drag = {c: F.col(c).between(0.1, 2.0) for c in ("ascent_cd", "chute_cd")}
    return {"name": F.length(F.trim("name")) > 0} | positive | drag | {"burst_diameter_m": F.col("burst_diameter_m") > F.col("launch_diameter_m"), "gas": F.upper("gas").isin("HELIUM", "HYDROGEN")}


def settings_rules() -> dict[str, Column]:
    """Rules of a simulation's settings (step_s, t_end_s, integrator, state_sample_stride)."""
    return {"step_s": (F.col("step_s") > 0) & (F.col("step_s") <= F.col("t_end_s")), "t_end_s": F.col("t_end_s") > 0, "integrator": F.upper(F.trim("integrator")).isin("RK4", "RKF45"), "state_sample_stride": F.col("state_sample_stride") >= 1}


def replay_rules() -> dict[str, Column]:
    """Rules of a replay's options (particles, filters, members, gap_s, every)."""
    return {"particles": (F.col("particles") >= 2) & (F.col("particles") >= 2 * F.col("filters")), "filters": F.col("filters") >= 1, "members": F.col("members") >= 1, "gap_s": F.col("gap_s") > 0, "every": F.col("every") >= 1}


def mission_rules() -> dict[str, Column]:
    """Rules of a mission (name, launch_lat, launch_lon, launch_alt_m, launch_epoch)."""
    return {"name": F.length(F.trim("name")) > 0, "launch_lat": F.col("launch_lat").between(-90, 90), "launch_lon": F.col("launch_lon").between(-180, 180), "launch_alt_m": F.col("launch_alt_m").between(-500, 6000), "launch_epoch_utc": F.col("launch_epoch").isNotNull()}


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def set_flag(flags: Column, bit: int, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), flags.bitwiseOR(F.lit(bit))).otherwise(flags)


def new_rows(incoming: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet."""
    return incoming.join(stored.select(*key).distinct(), key, "left_anti")


def conflicts(incoming: DataFrame, stored: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Incoming rows whose key is stored under another digest."""
    other = stored.select(*key, F.col(digest).alias("__stored"))
    return incoming.join(other, key).where(~F.col(digest).eqNullSafe(F.col("__stored"))).drop("__stored")


def identity(*columns: str) -> Column:
    """SHA-256 of the columns' text, joined by a bar; null is empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def tolerance_check(measured: Column, reference: Column, tolerance: float, relative: bool = True) -> tuple[Column, Column]:
    """Error, and whether it is within tolerance."""
    error = F.abs(measured - reference) / (F.abs(reference) if relative else 1)
    return error, error <= tolerance


def summarise_checks(checks: DataFrame) -> DataFrame:
    """Per case: checks, tolerance, worst error, whether all pass."""
    return checks.groupBy("case_name").agg(F.count("*").alias("checks"), F.max("tolerance").alias("tolerance"), F.max("error").alias("worst"), F.bool_and("passed").alias("passed"))


def error_reduction(frozen: Column, live: Column) -> Column:
    """Share by which a live error is under the frozen one; 0 where that is not positive."""
    return F.when(frozen > 0, (frozen - live) / frozen).otherwise(0.0)


def failure_budget(n: int) -> int:
    """Failures that an ensemble may have."""
    return max(1, n // 100)


def tampered(rows: DataFrame, stored: str, *columns: str) -> DataFrame:
    """Rows whose stored digest is not that of their columns."""
    return rows.where(~identity(*columns).eqNullSafe(F.col(stored)))


def recovery(bands: DataFrame, truth: DataFrame, key: list[str], by: list[str], tolerance: float) -> DataFrame:
    """Of estimated flights (low, median, high) with a `truth`: how many there are, how
    many bands cover it, and how many medians are within a tolerance."""
    joined = bands.join(truth, key)
    return joined.groupBy(*by).agg(F.count("*").alias("flights"), F.count_if(F.col("truth").between(F.col("low"), F.col("high"))).alias("covered"), F.count_if(F.abs(F.col("truth") - F.col("median")) <= tolerance).alias("recovered"))
