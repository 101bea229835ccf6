"""Stored tables: Parquet under one shared folder, with keys, cascades and refusals."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import running


class StoreError(RuntimeError):
    exit_code = 6


@dataclass(frozen=True)
class Table:
    """Schema, generated key (or None), and what refers to it: child -> (column, whether rows go with their parent)."""

    schema: str
    key: str | None = "id"
    children: tuple[tuple[str, str, bool], ...] = ()


# The stored tables and which of them refer to which.
TABLES = {
    "mission": Table("id long, name string, launch_lat double, launch_lon double, launch_alt_m double, ground_elev_m double, launch_epoch_utc timestamp", children=(("balloon_config", "mission_id", True), ("flight_log", "mission_id", True), ("run", "mission_id", False))),
    "balloon_config": Table("id long, mission_id long, name string, payload_mass_kg double, envelope_mass_kg double, launch_diameter_m double, burst_diameter_m double, free_lift_kg double, ascent_cd double, chute_area_m2 double, chute_cd double, gas string, config_hash string", children=(("run", "balloon_config_id", False),)),
    "sounding": Table("id long, station_id string, epoch_utc timestamp, source string, file_sha256 string, level_count long", children=(("sounding_level", "sounding_id", True), ("run", "sounding_id", False))),
    "sounding_level": Table("sounding_id long, height_gpm double, pressure_pa double, temperature_k double, wind_u_ms double, wind_v_ms double", None),
    "flight_log": Table("id long, mission_id long, name string, source_kind string, file_sha256 string, sample_count long, truth_json string", children=(("telemetry_sample", "flight_log_id", True), ("run", "flight_log_id", False))),
    "telemetry_sample": Table("flight_log_id long, epoch_utc timestamp, lat double, lon double, alt_gps_m double, pressure_pa double, temperature_k double, packet_id int, quality_flags int", None),
    "run": Table("id long, mission_id long, balloon_config_id long, sounding_id long, flight_log_id long, run_kind string, integrator string, step_s double, member_count long, rng_seed long, git_sha string, config_hash string, host_cores int, started_utc timestamp, wall_clock_ms long, status string", children=(("ensemble_member", "run_id", True), ("run_state", "run_id", True), ("estimate", "run_id", True), ("landing_ellipse", "run_id", True), ("validation_result", "run_id", True))),
    "ensemble_member": Table("run_id long, member_index long, free_lift_kg double, ascent_cd double, burst_diameter_m double, chute_cd double, wind_scale double, burst_alt_m double, landing_lat double, landing_lon double", None),
    "run_state": Table("run_id long, member_index long, t_s double, lat double, lon double, alt_m double, vz_ms double, diameter_m double, phase string, wind_extrapolated boolean", None),
    "estimate": Table("run_id long, update_epoch_utc timestamp, param_name string, median double, p05 double, p95 double, ess double, resample_count long", None),
    "landing_ellipse": Table("run_id long, update_epoch_utc timestamp, confidence double, center_lat double, center_lon double, semi_major_m double, semi_minor_m double, azimuth_deg double, area_km2 double", None),
    "validation_result": Table("run_id long, case_id string, quantity string, model_value double, reference_value double, unit string, tolerance double, tolerance_kind string, passed boolean", None),
}


def shared_root(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, on a local master only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise StoreError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lofted-store-")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


class Store:
    """Tables in versions: rows are appended to the last one, a deletion writes the next."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _versions(self, table: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where):
            return []
        whole = [s.getPath() for s in fs.listStatus(where) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(p.getName() for p in whole)

    def read(self, table: str) -> DataFrame:
        """The rows of a table, typed; empty if nothing was stored."""
        versions, schema = self._versions(table), TABLES[table].schema
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{versions[-1]}") if versions else self.spark.createDataFrame([], schema)

    def _typed(self, table: str, rows: DataFrame) -> DataFrame:
        """Columns of the schema, absent ones null and NaN as null."""
        fields = self.spark.createDataFrame([], TABLES[table].schema).schema
        cast = lambda f: (F.nanvl(F.col(f.name).cast("double"), F.lit(None).cast("double")) if f.dataType.simpleString() == "double" else F.col(f.name).cast(f.dataType))
        return rows.select(*[(cast(f) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])

    def insert(self, table: str, rows: DataFrame) -> None:
        """Appends rows; Spark commits them as a whole."""
        versions = self._versions(table)
        self._typed(table, rows).write.mode("append").parquet(f"{self.root}/{table}/{versions[-1] if versions else 'v000000'}")

    def insert_keyed(self, table: str, rows: DataFrame, order: list[str]) -> DataFrame:
        """Appends rows under new keys, in order (which begins with a number), and returns them with these."""
        key = TABLES[table].key
        top = self.read(table).agg(F.coalesce(F.max(key), F.lit(0)).alias("top")).first().top
        numbered = running(rows, [], order, {"__n": F.lit(1).cast("long")}).withColumn(key, F.col("__n") + F.lit(top)).select(*rows.columns, key)
        self.insert(table, numbered)
        return self.read(table).where(F.col(key) > top)

    def find(self, table: str, **key) -> DataFrame:
        """Rows by the values of columns, null equal to null; the filter reaches the scan."""
        out = self.read(table)
        for c, v in key.items():
            out = out.where(F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
        return out

    def scan(self, table: str, where: Column | None = None, order: tuple[str | Column, ...] = ()) -> DataFrame:
        """Rows that pass a filter, in order."""
        out = self.read(table)
        out = out if where is None else out.where(where)
        return out.orderBy(*order) if order else out

    def finish_run(self, run_id: int, status: str, wall_clock_ms: int) -> None:
        """Brings a run's row up to date."""
        own = F.col("id") == run_id
        self._replace("run", self.read("run").withColumn("status", F.when(own, status).otherwise(F.col("status"))).withColumn("wall_clock_ms", F.when(own, wall_clock_ms).otherwise(F.col("wall_clock_ms"))))

    def _replace(self, table: str, rows: DataFrame) -> None:
        versions = self._versions(table)
        rows.write.parquet(f"{self.root}/{table}/v{len(versions):06d}-{uuid.uuid4().hex}")

    def delete(self, table: str, ids: DataFrame) -> None:
        """Deletes rows by key with all that goes with them; refuses if other rows refer to them."""
        gone = ids.select(F.col(ids.columns[0]).cast("long").alias("__gone")).distinct()
        for child, column, cascades in TABLES[table].children:
            hit = self.read(child).join(gone, F.col(column) == F.col("__gone"), "left_semi")
            if not cascades and not hit.isEmpty():
                raise StoreError(f"{table} rows are referred to by {child}.{column}")
        for child, column, cascades in TABLES[table].children:
            if not cascades or not self._versions(child):
                continue
            rows = self.read(child)
            if TABLES[child].key:
                self.delete(child, rows.join(gone, F.col(column) == F.col("__gone"), "left_semi").select(TABLES[child].key))
            else:
                self._replace(child, rows.join(gone, F.col(column) == F.col("__gone"), "left_anti"))
        if self._versions(table):
            self._replace(table, self.read(table).join(gone, F.col(TABLES[table].key) == F.col("__gone"), "left_anti"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once, null equal to null."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def assemble(parents: DataFrame, children: DataFrame, key: str, parent: str, order: str, columns: list[str], out: str = "levels") -> DataFrame:
    """Parents with their children as an array in order; none is an empty array.  A
    parent's children must fit a row, as a profile's levels do."""
    item = F.struct(order, *[c for c in columns if c != order])
    own = children.groupBy(F.col(parent).alias("__parent")).agg(F.array_sort(F.collect_list(item)).alias(out))
    return parents.join(own, F.col(key) == F.col("__parent"), "left").drop("__parent").withColumn(out, F.coalesce(F.col(out), F.array().cast(own.schema[out].dataType)))
