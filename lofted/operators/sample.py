"""Latin-hypercube designs and reproducible noise, independent of partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.gauss import Distribution, inverse_cdf
from ..functions.geo import METRES_PER_DEGREE, metres_per_degree_lon
from .series import blocks


def uniform(seed: Column | int, *keys: Column) -> Column:
    """A number in (0, 1) that depends on the seed and keys alone."""
    s = seed if isinstance(seed, Column) else F.lit(seed)
    return (F.shiftrightunsigned(F.xxhash64(s, *keys), 11).cast("double") + 0.5) / 2.0**53


def normal(seed: Column | int, *keys: Column) -> Column:
    """A unit normal by Box and Muller."""
    radius = F.sqrt(-2 * F.log(uniform(seed, F.lit(0), *keys)))
    return radius * F.cos(2 * math.pi * uniform(seed, F.lit(1), *keys))


#: log2 of the ranges of hashes that strata are counted in.
_RANGE_BITS = 7


def unit_design(spark: SparkSession, n: int, dims: int, seed: int) -> DataFrame:
    """(member, dim, u): per dimension one point in each of n strata, jittered, off 0 and 1.

    A stratum is the rank of a hash, counted in ranges of hashes and within each.
    """
    rows = spark.range(n).withColumnRenamed("id", "member").select("member", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long"))).alias("dim"))
    rows = rows.withColumn("__h", F.xxhash64(F.lit(seed), "dim", "member")).withColumn("__r", F.shiftright("__h", 64 - _RANGE_BITS))
    before = Window.partitionBy("dim").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("dim", "__r").agg(F.count("*").alias("__n")).select("dim", "__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = rows.withColumn("__own", F.row_number().over(Window.partitionBy("dim", "__r").orderBy("__h", "member")) - 1)
    u = (F.col("__base") + F.col("__own") + uniform(seed + 1, F.col("dim"), F.col("member"))) / n
    return own.join(base, ["dim", "__r"]).select("member", "dim", F.least(F.greatest(u, F.lit(1e-12)), F.lit(1 - 1e-12)).alias("u"))


def designs(groups: DataFrame, by: list[str], n: int, dims: int, seed: Column) -> DataFrame:
    """(by, member, dim, u): a unit design of n members for each row of many groups."""
    sequence = lambda k: F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))
    rows = groups.select(*by, seed.alias("__seed"), F.explode(sequence(n)).alias("member")).select("*", F.explode(sequence(dims)).alias("dim"))
    order = Window.partitionBy(*by, "dim").orderBy(F.xxhash64("__seed", "dim", "member"), "member")
    u = (F.row_number().over(order) - 1 + uniform(F.col("__seed") + 1, F.col("dim"), F.col("member"))) / n
    return rows.select(*by, "member", "dim", F.least(F.greatest(u, F.lit(1e-12)), F.lit(1 - 1e-12)).alias("u"))


def design(spark: SparkSession, n: int, spec: list[tuple[str, Distribution]], seed: int) -> DataFrame:
    """(member, one column per name): a Latin hypercube through the marginals."""
    long = unit_design(spark, n, len(spec), seed).withColumn("z", inverse_cdf(F.col("u")))
    value = F.when(F.lit(False), F.lit(0.0))
    for k, (_, d) in enumerate(spec):
        value = value.when(F.col("dim") == k, d.quantile_column(F.col("u"), F.col("z")))
    names = [name for name, _ in spec]
    named = long.select("member", F.get(F.array(*map(F.lit, names)), F.col("dim").cast("int")).alias("name"), value.alias("value"))
    return named.groupBy("member").pivot("name", names).agg(F.first("value"))


def dropout_runs(df: DataFrame, by: list[str], order: list[str], starts: Column, rows: int = 3, out: str = "dropped", block: int | None = None) -> DataFrame:
    """Marks each row at which a dropout starts and the `rows` - 1 after it in its
    series; dropouts that overlap run on.  With `block` a long series is many tasks."""
    began = df.withColumn("__began", F.coalesce(starts, F.lit(False)).cast("int"))
    if block:
        began = blocks(began, by, order, rows - 1, block)
        w = Window.partitionBy(*by, "__block").orderBy("__n")
    else:
        w = Window.partitionBy(*by).orderBy(*order)
    marked = began.withColumn(out, F.max("__began").over(w.rowsBetween(1 - rows, 0)) == 1)
    return (marked.where(~F.col("__halo")) if block else marked).select(*df.columns, out)


# Noise of a tracker in metres, metres, a share of the pressure and kelvin; how often a dropout starts and how many samples it lasts.
NOISE = {"flat_m": 8.0, "alt_m": 10.0, "pressure": 0.002, "temperature_k": 1.0, "dropout": 0.004, "run": 3}


def noisy(df: DataFrame, by: list[str], order: list[str], seed: int, profile: dict | None = None, block: int | None = None) -> DataFrame:
    """Samples (lat, lon, alt_m, pressure_pa, temperature_k, and `by` and `order`, which
    tell a row apart) as a tracker gives them: places, altitudes, pressures and
    temperatures stray, and the altitude is missing in runs.  The noise is of the
    seed, `by` and `order` alone, however rows are dealt out; nulls stay null."""
    p = NOISE | (profile or {})
    keys = [F.col(c) for c in (*by, *order)]
    z = lambda name: normal(seed, F.lit(name), *keys)
    began = uniform(seed, F.lit("dropout"), *keys) < p["dropout"]
    marked = dropout_runs(df, by, order, began, p["run"], "__dropped", block)
    strayed = {
        "lat": F.col("lat") + z("lat") * p["flat_m"] / METRES_PER_DEGREE,
        "lon": F.col("lon") + z("lon") * p["flat_m"] / metres_per_degree_lon(F.col("lat")),
        "alt_m": F.when(~F.col("__dropped"), F.col("alt_m") + z("alt_m") * p["alt_m"]),
        "pressure_pa": F.col("pressure_pa") * (1 + z("pressure_pa") * p["pressure"]),
        "temperature_k": F.col("temperature_k") + z("temperature_k") * p["temperature_k"],
    }
    return marked.select(*[strayed[c].alias(c) if c in strayed else F.col(c) for c in df.columns])
