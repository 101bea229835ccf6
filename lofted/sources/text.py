"""Tolerant readers: each gives (good rows, rejects) and never drops a line unseen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import atmos
from ..functions.constants import CELSIUS_ZERO_K
from ..functions.geo import knots, wind_components
from ..operators.quality import DROPOUT, FROM_PRESSURE, INVERTED, mission_rules, set_flag, settings_rules
from ..operators.ranges import previous, running
from ..operators.series import anomalies


class DataFormatError(ValueError):
    """A file that cannot be used at all."""

    exit_code = 3


# Logical columns of a telemetry file and the headers they go by.
ALIASES = {
    "epoch_utc": ("epoch_utc", "time", "utc"),
    "packet_id": ("packet_id", "packet", "seq"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "longitude"),
    "alt_gps_m": ("alt_gps_m", "alt", "altitude"),
    "pressure_pa": ("pressure_pa", "pressure"),
    "temperature_k": ("temperature_k", "temperature", "temp"),
}
REQUIRED = ("epoch_utc", "packet_id", "lat", "lon")


def lines(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """file, sha256, line (from 1), text of each line of the files at `path`."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", charset)
    return files.select(F.col("path").alias("file"), digest(F.col("content")).alias("sha256"), F.posexplode(F.split(text, "\\R")).alias("i", "text")).select("file", "sha256", (F.col("i") + 1).alias("line"), "text")


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and text of each line of the UTF-8 files at `path`; a file is
    read by as many tasks as it has splits.

    Each split numbers its lines for itself; the counts of the splits before it, one
    row a split, give the number it begins with.  Lines end in \\n, \\r or \\r\\n.
    """
    return number_lines(spark.read.text(path))


def number_lines(raw: DataFrame) -> DataFrame:
    """`split_lines` of a text source's rows, of a batch or of one batch of a stream."""
    own = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    counts = own.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")
    begins = counts.select("file", "split", (before - F.col("first") + 1).alias("begin"))
    return own.join(begins, ["file", "split"]).select("file", (F.col("at") + F.col("begin")).alias("line"), "text")


def digest(content: Column) -> Column:
    """SHA-256 of a file's bytes."""
    return F.sha2(content, 256)


def present(c: Column) -> Column:
    """A trimmed token; null where it stands for an absent value."""
    return F.when(~F.lower(F.trim(c)).isin("", "nan", "-"), F.trim(c))


def optional_number(c: Column) -> Column:
    """A number; null for an absent token, and for one that is no number (see `is_junk`)."""
    return present(c).try_cast("double")


def is_junk(c: Column) -> Column:
    """Whether a token is neither absent nor a number."""
    return present(c).isNotNull() & present(c).try_cast("double").isNull()


def instant(c: Column) -> Column:
    """An ISO-8601 instant; one without a zone is UTC."""
    own = F.trim(c)
    # nothing that ends in two Z is a time; to try it would cost an exception a row
    zoned = F.when(~own.endswith("Z"), F.try_to_timestamp(F.concat(own, F.lit("Z"))))
    return F.when(own.rlike(r"^\d{4}-\d\d-\d\dT"), F.coalesce(zoned, F.try_to_timestamp(own)))


#: Lines of a file that one task compares with the lines before them.
BLOCK_LINES = 200_000


def read_telemetry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Telemetry CSV files: samples with flags and `line`, and rejects (file, line, reason, text).

    Comments and blanks are skipped, columns go by alias, others are ignored.  A
    bad row is rejected and does not claim its packet id; of equal ids the first
    kept one stays (the others are rejects, "duplicate").  A packet earlier than
    the one kept before it is flagged; a missing altitude is flagged and, where
    there is a pressure, derived from it.  A file without a usable header or a
    usable sample raises; `parse_telemetry` alone runs no job.
    """
    text = split_lines(spark, path)
    samples, rejects = parse_telemetry(text)
    check_telemetry(text, samples, rejects)
    return samples, rejects


NO_HEADER = "the file has no usable header"


def check_telemetry(text: DataFrame, samples: DataFrame, rejects: DataFrame) -> None:
    """Raises for files that cannot be used at all."""
    files = text.select("file").distinct().join(samples.select("file").distinct(), "file", "left_anti")
    told = files.join(rejects.groupBy("file").agg(F.bool_or(F.col("reason") == NO_HEADER).alias("headless")), "file", "left")
    worst = told.agg(F.min_by("file", F.struct(~F.coalesce("headless", F.lit(True)), "file")).alias("file"), F.min_by(F.coalesce("headless", F.lit(True)), F.struct(~F.coalesce("headless", F.lit(True)), "file")).alias("headless")).first()
    if worst.file is not None:
        raise DataFormatError(f"no usable header in {worst.file}" if worst.headless else f"no usable sample in {worst.file}")


def parse_telemetry(text: DataFrame, block: int = BLOCK_LINES) -> tuple[DataFrame, DataFrame]:
    """`read_telemetry` of lines that have been read (file, line, text), without a job
    and without holding a file in one task: headers are a minimum by line, packets
    are compared by id, arrival in blocks of `block` lines.  All lines of a file
    without a usable header are rejects."""
    body = text.select("file", "line", "text").where((F.trim("text") != "") & ~F.ltrim("text").startswith("#"))
    cells = F.transform(F.split("text", ","), lambda c: F.trim(c))
    # a header is cut into cells where it has been found, lines where their header is known
    first_line = body.groupBy("file").agg(F.min_by("text", "line").alias("text"), F.min("line").alias("head_line"))
    heads = first_line.select("file", "head_line", F.transform(cells, lambda c: F.lower(c)).alias("head"))
    known = heads.select("file", "head_line", *[F.array_max(F.array(*[F.array_position("head", a) for a in names])).cast("int").alias(f"at_{k}") for k, names in ALIASES.items()])
    headless = " or ".join(f"at_{k} = 0" for k in REQUIRED)
    cell = lambda k: F.when(F.col(f"at_{k}") > 0, F.try_element_at("cells", F.col(f"at_{k}")))
    # a row a file: sent to the lines, as a shuffle by file would bring a long log to one task
    rows = body.join(F.broadcast(known), "file").where(f"line > head_line or {headless}").withColumn("cells", cells)
    width = F.greatest(*[F.col(f"at_{k}") for k in ALIASES])
    optional = ("alt_gps_m", "pressure_pa", "temperature_k")
    junk = F.concat_ws(", ", *[F.when(is_junk(cell(k)), F.lit(k)) for k in optional])
    typed = rows.select("file", "line", "text", F.expr(headless).alias("headless"), (F.size("cells") >= width).alias("wide"), instant(cell("epoch_utc")).alias("epoch_utc"), cell("packet_id").try_cast("int").alias("packet_id"), cell("lat").try_cast("double").alias("lat"), cell("lon").try_cast("double").alias("lon"), *[optional_number(cell(k)).alias(k) for k in optional], junk.alias("junk"))
    reason = (
        F.when(F.col("headless"), NO_HEADER)
        .when(~F.col("wide"), "too few columns")
        .when(F.col("epoch_utc").isNull(), "epoch_utc is no instant")
        .when(F.col("packet_id").isNull(), "packet_id is no whole number")
        .when(~F.coalesce(F.col("lat").between(-90, 90), F.lit(False)), "lat out of range")
        .when(~F.coalesce(F.col("lon").between(-180, 180), F.lit(False)), "lon out of range")
        .when(F.col("junk") != "", F.concat("junk", F.lit(" is no number")))
        .when(F.col("pressure_pa") <= 0, "pressure_pa must be positive")
    )
    judged = typed.withColumn("reason", reason)
    first = F.row_number().over(Window.partitionBy("file", "packet_id").orderBy("line"))
    valid = judged.where("reason is null").withColumn("n", first)
    kept = valid.where("n = 1").drop("n", "headless", "wide", "reason", "junk")
    # worked out once, and only where it is needed
    kept = kept.withColumn("__derived", F.when(F.col("alt_gps_m").isNull(), atmos.pressure_altitude(F.col("pressure_pa"))))
    derived = F.col("__derived")
    arrived = previous(kept, ["file"], "line", "epoch_utc", block, "__before")
    flags = set_flag(F.lit(0), INVERTED, F.col("epoch_utc") < F.col("__before"))
    flags = set_flag(set_flag(flags, DROPOUT, F.col("alt_gps_m").isNull()), FROM_PRESSURE, F.col("alt_gps_m").isNull() & derived.isNotNull())
    samples = arrived.withColumn("flags", flags).withColumn("alt_m", F.coalesce("alt_gps_m", derived)).drop("text", "__before", "__derived")
    # a pressure outside the model is reported, its sample stays without an altitude
    outside = kept.where(F.col("alt_gps_m").isNull() & F.col("pressure_pa").isNotNull() & derived.isNull()).select("file", "line", F.lit("pressure_pa is outside the model").alias("reason"), "text")
    rejects = judged.where("reason is not null").select("file", "line", "reason", "text").unionByName(valid.where("n > 1").select("file", "line", F.lit("duplicate packet_id").alias("reason"), "text")).unionByName(outside)
    return samples, rejects


def follow_telemetry(spark: SparkSession, folder: str, out: str):
    """Reads the files that come to `folder` as a stream until there are no more: one
    row in `out`/samples or `out`/rejects for each line, as `parse_telemetry` has it.

    A file comes in one batch as a whole, so its header and its packet ids are
    judged there.  A batch is written to a folder of its own number and written
    over if it is run again, so a run that is begun anew gives nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        for rows, name in zip(parse_telemetry(number_lines(batch)), ("samples", "rejects")):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    raw = spark.readStream.text(folder).select("value", "_metadata")
    return raw.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()


def in_order(samples: DataFrame, parts: int = 1) -> DataFrame:
    """Samples with `place`, from 1, by time and then packet_id in each file; the flags
    were set in order of arrival.  With `parts` over 1 a file is numbered in ranges of time."""
    if parts > 1:
        return running(samples, ["file"], ["epoch_utc", "packet_id"], {"place": F.lit(1).cast("long")}, parts).drop("place_before", "place_total")
    return samples.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("epoch_utc", "packet_id")))


def anomaly_summary(samples: DataFrame, rejects: DataFrame) -> DataFrame:
    """Per file: kept, inverted, dropouts, derived altitudes, duplicates and other rejects."""
    duplicate = F.col("reason") == "duplicate packet_id"
    told = rejects.groupBy("file").agg(F.count_if(duplicate).alias("duplicates"), F.count_if(~duplicate).alias("rejected"))
    out = anomalies(samples, ["file"]).join(told, "file", "left")
    return out.na.fill(0, ["duplicates", "rejected"])


def read_sounding(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Wyoming-style sounding text: levels (file, station, line, pressure_pa,
    height_gpm, temperature_k, wind_u_ms, wind_v_ms) and rejects.

    Lines that do not begin with a number are headings; data lines need eight
    fields in range; repeated heights keep the first.  A file with fewer than two
    levels raises.
    """
    text = split_lines(spark, path)
    levels, rejects = parse_sounding(text)
    few = text.select("file").distinct().join(levels.groupBy("file").agg(F.count("*").alias("n")), "file", "left").where(F.coalesce("n", F.lit(0)) < 2)
    if worst := few.agg(F.min("file")).first()[0]:
        raise DataFormatError(f"fewer than two levels in {worst}")
    return levels, rejects


def parse_sounding(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`read_sounding` of lines that have been read (file, line, text), without a job."""
    body = text.where((F.trim("text") != "") & ~F.ltrim("text").startswith("#"))
    station = body.where(F.lower("text").contains("station identifier")).groupBy("file").agg(F.min_by(F.trim(F.substring_index("text", ":", -1)), "line").alias("station"))
    cells = F.split(F.trim("text"), "\\s+")
    data = body.withColumn("cells", cells).where(F.try_element_at("cells", F.lit(1)).try_cast("double").isNotNull())
    at = lambda k: F.try_element_at("cells", F.lit(k + 1)).try_cast("double")
    u, v = wind_components(at(6), knots(at(7)))
    typed = data.select("file", "line", "text", F.size("cells").alias("n"), (at(0) * 100).alias("pressure_pa"), at(1).alias("height_gpm"), (at(2) + CELSIUS_ZERO_K).alias("temperature_k"), at(6).alias("dir"), at(7).alias("knots"), u.alias("wind_u_ms"), v.alias("wind_v_ms"))
    inside = lambda ok: F.coalesce(F.expr(ok), F.lit(False))
    reason = F.when(F.col("n") < 8, "fewer than eight fields").when(F.expr("pressure_pa is null or height_gpm is null or temperature_k is null or dir is null or knots is null"), "not a number")
    for ok in ("pressure_pa > 0", "height_gpm >= -500", "temperature_k between 150 and 340", "dir between 0 and 360", "knots >= 0"):
        reason = reason.when(~inside(ok), f"not {ok}")
    judged = typed.withColumn("reason", reason)
    first = F.row_number().over(Window.partitionBy("file", "height_gpm").orderBy("line"))
    valid = judged.where("reason is null").withColumn("r", first)
    levels = valid.where("r = 1").join(station, "file", "left").select("file", "station", "line", "pressure_pa", "height_gpm", "temperature_k", "wind_u_ms", "wind_v_ms")
    rejects = judged.where("reason is not null").select("file", "line", "reason", "text").unionByName(valid.where("r > 1").select("file", "line", F.lit("repeated height").alias("reason"), "text"))
    return levels, rejects


def read_table_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and # comments, such as seed lists and reference tables."""
    return spark.read.csv(path, schema=schema, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


#: Fields that a balloon's configuration must have, of text and of numbers.
BALLOON_TEXT = ("name", "gas")
BALLOON_NUMBERS = ("payload_mass_kg", "envelope_mass_kg", "launch_diameter_m", "burst_diameter_m", "free_lift_kg", "ascent_cd", "chute_area_m2", "chute_cd")
#: Settings of a simulation and what they are where the document does not name them.
SIM_DEFAULTS = {"step_s": 0.25, "integrator": "RK4", "t_end_s": 21_600.0, "state_sample_stride": 10}


def parse_balloons(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with the fields of a balloon's JSON and `error`: null, or what is
    wrong with the first bad field, by name.  Numbers must be JSON numbers."""
    raw = lambda f: F.get_json_object(text, f"$.{f}")
    quoted = lambda f: F.col(text).rlike(f'"{f}"\\s*:\\s*"')
    error = F.when(F.get_json_object(text, "$").isNull(), "not valid JSON")
    for f in BALLOON_TEXT:
        error = error.when(F.coalesce(F.trim(raw(f)), F.lit("")) == "", f"{f} is required")
    for f in BALLOON_NUMBERS:
        error = error.when(raw(f).isNull(), f"{f} is required").when(quoted(f) | raw(f).try_cast("double").isNull(), f"{f} must be a number")
    error = error.when(~F.upper(F.trim(raw("gas"))).isin("HELIUM", "HYDROGEN"), "gas must be one of HELIUM, HYDROGEN")
    return documents.select("*", raw("name").alias("name"), F.upper(F.trim(raw("gas"))).alias("gas"), *[raw(f).try_cast("double").alias(f) for f in BALLOON_NUMBERS], error.alias("error"))


#: Fields that a mission must have, of text and of numbers.
MISSION_TEXT, MISSION_NUMBERS = ("name", "launch_epoch_utc"), ("launch_lat", "launch_lon", "launch_alt_m")


def parse_missions(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with the fields of a mission's JSON, launch_epoch (a timestamp),
    ground_elev_m (the launch's altitude where it is not given), the settings under
    `sim` and `error`: null, or what is wrong with the first bad field, by name."""
    raw = lambda f: F.get_json_object(text, f"$.{f}")
    quoted = lambda f: F.col(text).rlike(f'"{f}"\\s*:\\s*"')
    number = lambda f: F.when(~quoted(f), raw(f).try_cast("double"))
    own = documents.select("*", raw("name").alias("name"), *[number(f).alias(f) for f in MISSION_NUMBERS], F.coalesce(number("ground_elev_m"), number("launch_alt_m")).alias("ground_elev_m"), instant(raw("launch_epoch_utc")).alias("launch_epoch"))
    own = parse_settings(own, text)
    error = F.when(F.get_json_object(text, "$").isNull(), "not valid JSON")
    for f in MISSION_TEXT:
        error = error.when(F.coalesce(F.trim(raw(f)), F.lit("")) == "", f"{f} is required")
    for f in MISSION_NUMBERS:
        error = error.when(raw(f).isNull(), f"{f} is required").when(number(f).isNull(), f"{f} must be a number")
    for f, ok in (mission_rules() | settings_rules()).items():
        error = error.when(~F.coalesce(ok, F.lit(False)), f"{f} is out of range")
    return own.withColumn("error", error)


def parse_settings(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with the settings under `sim`, defaults for those it does not name."""
    kind = {str: "string", float: "double", int: "int"}
    return documents.select("*", *[F.coalesce(F.get_json_object(text, f"$.sim.{k}").try_cast(kind[type(v)]), F.lit(v)).alias(k) for k, v in SIM_DEFAULTS.items()])
