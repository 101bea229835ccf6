"""Command line: ingest, predict, replay, synth, validate and version.

Each verb is a Spark job over files and writes its results as Parquet and text to
a folder.  Exit codes: 0 all well, 1 usage, 2 a value out of range, 3 data format,
4 the model, 5 no convergence, 6 stored data, 70 anything else.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .operators import ellipse, quality
from .plans import provenance, replay, sim, synth, validate
from .sources import frames, sinks, text

VERSION, SCHEMA_VERSION = "0.3", 1
USAGE, VALIDATION, MODEL, UNEXPECTED = 1, 2, 4, 70
LEVELS = (0.5, 0.95)


class UsageError(Exception):
    exit_code = USAGE


class ValidationError(ValueError):
    """A field that is out of range, by name."""

    exit_code = VALIDATION


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise UsageError(f"{message}\n{self.format_usage()}")


def parser() -> argparse.ArgumentParser:
    made = _Parser(prog="lofted")
    verbs = made.add_subparsers(dest="verb", required=True, parser_class=_Parser)

    def verb(name: str, help_: str, *required: str, **optional) -> None:
        own = verbs.add_parser(name, help=help_)
        for option in required:
            own.add_argument(f"--{option}", required=True)
        for option, default in optional.items():
            own.add_argument(f"--{option.replace('_', '-')}", default=default, type=str if default is None else type(default))

    verb("ingest", "read missions, balloons, soundings and logs; write good rows and rejects", mission=None, balloon=None, sounding=None, log=None, out="out")
    verb("predict", "fly an ensemble and write its footprint", "mission", "balloon", sounding=None, step=0.25, integrator="RK4", members=1, seed=42, out="out")
    verb("replay", "estimate from a log and predict the landing anew", "mission", "balloon", "log", sounding=None, every=1, particles=2000, filters=16, members=200, gap=50.0, seed=42, step=0.25, out="out")
    verb("synth", "make flights of known truth from a list of seeds", "mission", "balloon", "seeds", interval=1.0, step=0.25, out="out")
    verb("validate", "compare the model with a table of the atmosphere and with itself", reference=None, step=0.25, out="out")
    verb("version", "what this is")
    return made


def _one(documents: DataFrame, path: str) -> Row:
    """The single document of a path; an error in it is raised, by field."""
    rows = documents.limit(2).collect()
    if len(rows) != 1:
        raise text.DataFormatError(f"{path} must hold one document")
    if rows[0].error:
        kind = text.DataFormatError if rows[0].error == "not valid JSON" else ValidationError
        raise kind(f"{path}: {rows[0].error}")
    return rows[0]


def _document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def mission(spark: SparkSession, path: str) -> Row:
    return _one(text.parse_missions(_document(spark, path)), path)


def balloon(spark: SparkSession, path: str) -> Row:
    """A balloon's fields, within their rules."""
    row = _one(text.parse_balloons(_document(spark, path)), path)
    bad = quality.split_by_rules(spark.createDataFrame([row], _BALLOON), quality.balloon_rules())[1].first()
    if bad:
        raise ValidationError(f"{path}: {', '.join(bad.reasons)} out of range")
    return row


_BALLOON = "text string, name string, gas string, payload_mass_kg double, envelope_mass_kg double, launch_diameter_m double, burst_diameter_m double, free_lift_kg double, ascent_cd double, chute_area_m2 double, chute_cd double, error string"


def _flight(spark: SparkSession, o) -> tuple[sim.Config, sim.Settings]:
    """The configuration and settings of a mission and a balloon; a sounding gives the wind."""
    m, b = mission(spark, o.mission), balloon(spark, o.balloon)
    names = ("payload_mass_kg", "envelope_mass_kg", "free_lift_kg", "ascent_cd", "burst_diameter_m", "chute_area_m2", "chute_cd", "gas")
    config = sim.Config(**{n: b[n] for n in names}, launch=(m.launch_lat, m.launch_lon, m.launch_alt_m))
    settings = sim.Settings(step_s=o.step, integrator=getattr(o, "integrator", m.integrator), t_end_s=m.t_end_s, stride=m.state_sample_stride, ground_m=m.ground_elev_m)
    if getattr(o, "sounding", None):
        levels = text.read_sounding(spark, o.sounding)[0].orderBy("height_gpm").collect()  # one ascent's levels
        settings = replace(settings, wind=sim.Wind(*(tuple(r[c] for r in levels) for c in ("height_gpm", "wind_u_ms", "wind_v_ms"))))
    return config, settings


def _tell(lines: DataFrame, *order: str) -> None:
    for row in lines.orderBy(*order).collect():
        print("  " + row.line)


def ingest(spark: SparkSession, o) -> int:
    if not (o.mission or o.balloon or o.sounding or o.log):
        raise UsageError("ingest needs a mission, a balloon, a sounding or a log")
    if o.mission:
        mission(spark, o.mission)
        text.parse_missions(_document(spark, o.mission)).drop("text", "error").write.mode("overwrite").parquet(f"{o.out}/mission")
    if o.balloon:
        balloon(spark, o.balloon)
        text.parse_balloons(_document(spark, o.balloon)).drop("text", "error").withColumn("config_hash", quality.identity("name", "gas", *text.BALLOON_NUMBERS)).write.mode("overwrite").parquet(f"{o.out}/balloon")
    for path, name, reader in ((o.sounding, "sounding", text.read_sounding), (o.log, "telemetry", text.read_telemetry)):
        if path:
            for rows, kind in zip(reader(spark, path), ("rows", "rejects")):
                run = provenance.Run(0)
                run.write(rows, f"{o.out}/{name}/{kind}")
                print(f"  {name}: {run.record['rows']} {kind}")
    return 0


def predict(spark: SparkSession, o) -> int:
    if o.members < 1:
        raise ValidationError("members must be at least 1")
    config, settings = _flight(spark, o)
    run = provenance.Run(o.seed)
    if o.members == 1:
        members = spark.createDataFrame([(0, *(float(v[0]) for v in sim.nominal(config).values()))], "member long, " + ", ".join(f"{p} double" for p in sim.PARAMETERS))
        flown = sim.simulate(members, config, settings)
    else:
        flown = sim.ensemble(spark, o.members, o.seed, config, settings)
    landings = run.write(flown, f"{o.out}/members", F.col("status") != "OK")
    run.table(spark).write.mode("overwrite").parquet(f"{o.out}/run")
    ok = landings.where("status = 'OK'").withColumn("run", F.lit(run.run))
    fitted = [ellipse.fit(ok, ["run"], level) for level in LEVELS]
    both = fitted[0].unionByName(fitted[1])
    both.write.mode("overwrite").parquet(f"{o.out}/ellipses")
    sinks.footprint_features(both, ok, ["run"]).select("feature").write.mode("overwrite").text(f"{o.out}/footprint")
    frames.outlines(both, ["run"]).write.mode("overwrite").parquet(f"{o.out}/outlines")
    print(f"  {run.record['rows']} members, {run.record['failures']} failed, {run.record['elapsed_ms']} ms on {run.record['cores']} cores")
    _tell(sinks.console_footprint(both, ["run"]), "confidence", "place")
    return 0


def run_replay(spark: SparkSession, o) -> int:
    options = spark.createDataFrame([(o.particles, o.filters, o.members, o.gap, o.every)], "particles int, filters int, members int, gap_s double, every int")
    bad = quality.split_by_rules(options, quality.replay_rules())[1].first()
    if bad:
        raise ValidationError(f"{', '.join(bad.reasons)} out of range")
    config, settings = _flight(spark, o)
    start = mission(spark, o.mission).launch_epoch
    samples, _ = text.read_telemetry(spark, o.log)
    log = samples.select((F.unix_micros("epoch_utc") / 1e6 - F.unix_micros(F.lit(start)) / 1e6).alias("s"), "lat", "lon", "alt_m", quality.has_flag(F.col("flags"), quality.FROM_PRESSURE).alias("by_pressure"))
    made = replay.run(log, config, settings, o.filters, o.particles // o.filters, o.seed, o.every, o.gap, o.members)
    for name, rows in made.items():
        rows.write.mode("overwrite").parquet(f"{o.out}/{name}")
    _tell(sinks.console_replay(spark.read.parquet(f"{o.out}/estimates").withColumn("run", F.lit("")), ["run"], o.particles), "param")
    return 0


def run_synth(spark: SparkSession, o) -> int:
    config, settings = _flight(spark, o)
    seeds = text.read_table_csv(spark, o.seeds, "name string, seed long, launch_epoch_utc timestamp")
    truths = synth.truths(seeds, config, settings)
    truths.write.mode("overwrite").parquet(f"{o.out}/truths")
    synth.telemetry(spark.read.parquet(f"{o.out}/truths"), config, settings, interval_s=o.interval).write.mode("overwrite").parquet(f"{o.out}/telemetry")
    print(f"  {spark.read.parquet(f'{o.out}/truths').count()} flights")
    return 0


def run_validate(spark: SparkSession, o) -> int:
    checks = validate.flight_checks(spark, step_s=o.step, steps=(o.step,))
    if o.reference:
        table = text.read_table_csv(spark, o.reference, "altitude_m double, temperature_k double, pressure_pa double, density_kg_m3 double")
        checks = checks.unionByName(validate.atmosphere_checks(table))
    judged = validate.judged(checks)
    judged.write.mode("overwrite").parquet(f"{o.out}/checks")
    told = quality.summarise_checks(spark.read.parquet(f"{o.out}/checks"))
    _tell(sinks.console_checks(told), "case_name")
    return 0 if told.agg(F.bool_and("passed")).first()[0] else MODEL


def version(_: SparkSession | None, o) -> int:
    print(f"lofted {VERSION}, schema {SCHEMA_VERSION}, commit {provenance.commit()}")
    return 0


VERBS = {"ingest": ingest, "predict": predict, "replay": run_replay, "synth": run_synth, "validate": run_validate, "version": version}


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one verb; the exit code.  What went wrong is told in one line."""
    try:
        options = parser().parse_args(arguments)
        session = spark if spark or options.verb == "version" else SparkSession.builder.appName("lofted").getOrCreate()
        return VERBS[options.verb](session, options)
    except SystemExit as e:  # asked for help
        return int(e.code or 0)
    except Exception as e:
        code = getattr(e, "exit_code", VALIDATION if isinstance(e, ValueError) else UNEXPECTED)
        print(f"error: {e}", file=sys.stderr)
        return code


if __name__ == "__main__":
    sys.exit(main())
