"""Text and table sinks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ellipse import area_m2, ring
from ..operators.weights import degenerate


def fixed(name: str, decimals: int) -> Column:
    """A number with fixed decimals as text; blank where there is none."""
    return F.when(F.col(name).isNotNull(), F.format_string(f"%.{decimals}f", F.col(name).cast("double"))).otherwise("").alias(name)


def trajectory_rows(states: DataFrame) -> DataFrame:
    """run_id and the columns of a trajectory file, as text."""
    numbers = [fixed(c, d) for c, d in (("s", 3), ("lat", 7), ("lon", 7), ("alt_m", 3), ("vz_ms", 4), ("diameter_m", 4))]
    return states.select("run_id", *numbers, "phase", F.col("wind_extrapolated").cast("int").cast("string").alias("wind_extrapolated"))


def scatter_rows(members: DataFrame) -> DataFrame:
    """Landings as text; failed members stay, with blanks and their status."""
    ok = F.col("status") == "OK"
    told = members.withColumns({c: F.when(ok, F.col(c)) for c in ("lat", "lon", "burst_alt_m")})
    numbers = [fixed(c, d) for c, d in (("lat", 7), ("lon", 7), ("burst_alt_m", 1), ("free_lift_kg", 6), ("ascent_cd", 6), ("burst_diameter_m", 6), ("chute_cd", 6), ("wind_scale", 6))]
    return told.select("member", *numbers, F.when(ok, "OK").otherwise("FAILED").alias("status"))


def ellipse_rows(ellipses: DataFrame) -> DataFrame:
    """run_id and the columns of an ellipse file, as text."""
    own = ellipses.withColumn("area_km2", area_m2() / 1e6)
    return own.select("run_id", *[fixed(c, d) for c, d in (("confidence", 4), ("centre_lat", 7), ("centre_lon", 7), ("semi_major_m", 2), ("semi_minor_m", 2), ("azimuth_deg", 3), ("area_km2", 4))], F.col("n").cast("string").alias("member_count"))


def summary_rows(runs: DataFrame) -> DataFrame:
    """One line per trajectory summary (`series.summary`), as text."""
    return runs.select("run_id", *[fixed(c, d) for c, d in (("burst_alt_m", 1), ("burst_s", 1), ("landing_lat", 7), ("landing_lon", 7), ("duration_s", 1), ("apogee_m", 1))], F.col("states").cast("string").alias("states"), F.col("wind_held").cast("string").alias("wind_held"))


def manifest_rows(truths: DataFrame) -> DataFrame:
    """The line of each generated flight, as text."""
    return truths.select("name", F.col("seed").cast("string").alias("seed"), *[fixed(c, d) for c, d in (("free_lift_kg", 6), ("ascent_cd", 6), ("burst_diameter_m", 6), ("chute_cd", 6), ("wind_scale", 6), ("burst_alt_m", 1), ("landing_lat", 7), ("landing_lon", 7))], F.col("sample_count").cast("string").alias("sample_count"))


def telemetry_rows(samples: DataFrame) -> DataFrame:
    """Lines of telemetry files, as text: flight, packet_id, epoch_utc, lat, lon, alt_gps_m
    (blank in dropouts), pressure_pa and temperature_k."""
    named = samples.withColumn("alt_gps_m", F.col("alt_m"))
    return named.select("flight", "packet_id", F.date_format("epoch_utc", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("epoch_utc"), *[fixed(c, d) for c, d in (("lat", 6), ("lon", 6), ("alt_gps_m", 1), ("pressure_pa", 1), ("temperature_k", 2))])


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows of text as CSV files with a header; blanks stay blank."""
    rows.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def truth_json(truths: DataFrame, *columns: str) -> DataFrame:
    """`truths` with the columns as one JSON text, nulls told."""
    return truths.withColumn("truth_json", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def summary(members: DataFrame) -> DataFrame:
    """One row: members, failures and their rate, whether the budget allows them, mean
    burst altitude and flight time of the others."""
    ok = F.col("status") == "OK"
    n, bad = F.count("*"), F.count_if(~ok)
    budget = F.greatest(F.lit(1), F.floor(n / 100))
    return members.agg(n.alias("members"), bad.alias("failed"), (bad / n).alias("failure_rate"), (bad <= budget).alias("within_budget"), F.avg(F.when(ok, F.col("burst_alt_m"))).alias("mean_burst_alt_m"), F.avg(F.when(ok, F.col("landing_s"))).alias("mean_flight_s"))


def console_checks(checks: DataFrame) -> DataFrame:
    """case_name and the line of a validation's table for each case of `quality.summarise_checks`."""
    line = F.format_string("  %-10s %3d checks, tolerance %.3f%% worst %.5f%% %s", "case_name", F.col("checks"), F.col("tolerance") * 100, F.col("worst") * 100, F.when(F.col("passed"), "PASS").otherwise("FAIL"))
    return checks.select("case_name", line.alias("line"))


def _told(rows: DataFrame, by: list[str], *parts: Column) -> DataFrame:
    """by, place and line: the parts of a row that are not null, one below the other."""
    said = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return rows.select(*by, F.posexplode(said).alias("place", "line"))


def console_prediction(summaries: DataFrame, by: list[str]) -> DataFrame:
    """The lines that tell of a flight, from `series.summary`: by, place, line."""
    c = F.col
    return _told(
        summaries, by,
        F.when(c("burst_s").isNotNull(), F.format_string("burst at %.0f m after %.0f s", "burst_alt_m", "burst_s")),
        F.when(c("landing_lat").isNotNull(), F.format_string("lands at %.6f, %.6f", "landing_lat", "landing_lon")),
        F.format_string("in flight for %.0f s, %.0f min", "duration_s", c("duration_s") / 60),
        F.format_string("highest at %.0f m", "apogee_m"),
        F.when(c("wind_held") > 0, F.format_string("warning: wind held beyond the sounding in %d of %d states", "wind_held", "states")),
    )


def console_footprint(ellipses: DataFrame, by: list[str]) -> DataFrame:
    """The lines that tell of landing ellipses, the widest last: by, confidence, place, line."""
    c = F.col
    return _told(
        ellipses, [*by, "confidence"],
        F.format_string("%.0f%% of %d members about %.6f, %.6f", c("confidence") * 100, "n", "centre_lat", "centre_lon"),
        F.format_string("%.2f by %.2f km on %.0f degrees, %.2f square km", c("semi_major_m") / 500, c("semi_minor_m") / 500, "azimuth_deg", math.pi * c("semi_major_m") * c("semi_minor_m") / 1e6),
    )


def console_flights(truths: DataFrame) -> DataFrame:
    """A line for each flight that was made up (name, burst_alt_m, ascent_cd, free_lift_kg,
    sample_count), and one, without a name, for the span of their bursts."""
    own = truths.select("name", F.format_string("%-16s burst %.0f m, drag %.4f, lift %.4f kg, %d samples", "name", "burst_alt_m", "ascent_cd", "free_lift_kg", "sample_count").alias("line"))
    span = truths.agg(F.format_string("%d flights burst from %.0f to %.0f m", F.count("*"), F.min("burst_alt_m"), F.max("burst_alt_m")).alias("line"))
    return own.unionByName(span.select(F.lit(None).cast("string").alias("name"), "line"))


def console_replay(bands: DataFrame, by: list[str], particles: int) -> DataFrame:
    """A line for each parameter's band at the last update (by, s, param, q05, q50, q95,
    ess), with a warning where too few particles carry the weight: by, param, line."""
    last = bands.groupBy(*by, "param").agg(F.max_by(F.struct("q05", "q50", "q95", "ess"), "s").alias("b"))
    thin = F.when(degenerate(F.col("b.ess"), F.lit(float(particles))), F.format_string(", from %.0f of %d particles only", "b.ess", F.lit(particles))).otherwise("")
    return last.select(*by, "param", F.concat(F.format_string("%-16s %.4f, 5 to 95 %% from %.4f to %.4f", "param", "b.q50", "b.q05", "b.q95"), thin).alias("line"))


def _feature(geometry, **properties):
    return F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[v.alias(k) for k, v in properties.items()]).alias("properties"))


def footprint_geojson(ellipses: DataFrame) -> DataFrame:
    """One GeoJSON text per ellipse row: its ring and its centre."""
    points = F.transform(ring(), lambda p: F.array(p["lon"], p["lat"]))
    polygon = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    centre = F.struct(F.lit("Point").alias("type"), F.array("centre_lon", "centre_lat").alias("coordinates"))
    both = [F.to_json(_feature(g, confidence=F.col("confidence"))) for g in (polygon, centre)]
    return ellipses.select(F.format_string('{"type":"FeatureCollection","features":[%s,%s]}', *both).alias("value"))


def point_feature(name: Column, lon: Column, lat: Column, alt: Column) -> Column:
    """A named GeoJSON point; GeoJSON puts the longitude first."""
    return F.format_string('{"type":"Feature","properties":{"name":"%s"},"geometry":{"type":"Point","coordinates":[%.7f,%.7f,%.1f]}}', name, lon, lat, alt)


def footprint_features(ellipses: DataFrame, members: DataFrame, by: list[str], running_on: bool = False) -> DataFrame:
    """by and one GeoJSON feature a row (kind: ellipse, centre or member): rings of
    ellipses, their centres, and the landings of members; failed members have none.
    With `running_on` the longitudes of rings are not turned into [-180, 180)."""
    corner = F.transform(ring(running_on=running_on), lambda p: F.format_string("[%.7f,%.7f]", p["lon"], p["lat"]))
    name = F.format_string("%.0f%%", F.col("confidence") * 100)
    polygon = F.format_string('{"type":"Feature","properties":{"name":"%s ellipse"},"geometry":{"type":"Polygon","coordinates":[[%s]]}}', name, F.concat_ws(",", corner))
    centre = point_feature(F.concat(F.lit("centre "), name), F.col("centre_lon"), F.col("centre_lat"), F.lit(0.0))
    landed = members.where("status = 'OK'").select(*by, F.lit("member").alias("kind"), point_feature(F.format_string("member %d", "member"), F.col("lon"), F.col("lat"), F.col("alt_m")).alias("feature"))
    return ellipses.select(*by, F.lit("ellipse").alias("kind"), polygon.alias("feature")).unionByName(ellipses.select(*by, F.lit("centre").alias("kind"), centre.alias("feature"))).unionByName(landed)


def flight_geojson(states: DataFrame) -> DataFrame:
    """run_id and one GeoJSON text per run: the track and its burst and landing points."""
    track = F.array_sort(F.collect_list(F.struct("s", "lon", "lat", "alt_m", "phase")))
    runs = states.groupBy("run_id").agg(track.alias("t"))
    place = lambda p: F.array(p["lon"], p["lat"], p["alt_m"])
    line = F.to_json(_feature(F.struct(F.lit("LineString").alias("type"), F.transform("t", place).alias("coordinates")), kind=F.lit("track")))
    marks = F.transform(F.filter("t", lambda p: p["phase"].isin("BURST", "LANDED")), lambda p: F.to_json(_feature(F.struct(F.lit("Point").alias("type"), place(p).alias("coordinates")), kind=F.lower(p["phase"]))))
    return runs.select("run_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.array(line), marks), F.lit("]}")).alias("value"))


def append(df: DataFrame, path: str, key: str = "run_id") -> None:
    """Appends rows to a table partitioned by `key`; Spark commits a write as a whole."""
    df.write.mode("append").partitionBy(key).parquet(path)


def latest_runs(log: DataFrame) -> DataFrame:
    """The last event of each run of an append-only log."""
    return log.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "run_id"]), "at").alias("r")).select("run_id", "r.*")


def without(table: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """A table less the rows of deleted keys, for cascades."""
    return table.join(deleted.select(key).distinct(), key, "left_anti")


def plot_frame(df: DataFrame, x: str, y: str, margin: float = 0.12) -> DataFrame:
    """Equal-scale bounds about all points."""
    b = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    half = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * (0.5 + margin)
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return b.select((cx - half).alias("x_min"), (cx + half).alias("x_max"), (cy - half).alias("y_min"), (cy + half).alias("y_max"))
