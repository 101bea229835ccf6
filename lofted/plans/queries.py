"""Driver queries: operators on the driver's tables, each with DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import atmos, geo, units
from ..functions.constants import EARTH_RADIUS_M, LAYERS, LENGTH_M, POTENTIAL_RADIUS_M
from ..operators import ellipse as el
from ..operators import interp, quality, sample, series, weights

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with `s`, seconds since 2024."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - 1_704_067_200_000_000
    return read(spark, sf_dir, "events").withColumn("s", micros / 1e6)


_S = "epoch_us(ts) / 1e6 - 1704067200"
_E = f"(select *, (epoch_us(ts) - 1704067200000000) / 1e6 as s from events)"
BY, ORDER = ["user_id"], ["s", "event_id"]
_W = "over (partition by user_id order by s, event_id"


@query(f"""select event_id, user_id, round(case when count(value) {_W} rows between 8 preceding and current row) = 9
  then coalesce(regr_slope(value, s) {_W} rows between 8 preceding and current row), 0) end, 6) as slope from {_E} where value is not null""")
def rolling_slope(spark, sf):
    out = series.rolling_slope(events(spark, sf), BY, ORDER, "value", "s")
    return out.select("event_id", "user_id", F.round("slope", 6).alias("slope"))


@query(f"""with w as (select *, coalesce(lag(value) {_W}), value) v0, coalesce(lag(s) {_W}), s) s0, coalesce(lead(value) {_W}), value) v1, coalesce(lead(s) {_W}), s) s1 from {_E})
select event_id, round(case when s1 > s0 then (v1 - v0) / (s1 - s0) end, 6) as rate from w""")
def finite_difference(spark, sf):
    return series.finite_difference(events(spark, sf), BY, ORDER, "value", "s").select("event_id", F.round("rate", 6).alias("rate"))


def _altitude(spark, sf):
    """A height that rises and falls: each user's running sum of values about their mean."""
    e, w = events(spark, sf), Window.partitionBy("user_id")
    rank = F.row_number().over(w.orderBy(*ORDER))
    return e.withColumn("s", rank.cast("double")).withColumn("n", F.count("*").over(w)).withColumn("alt", F.when(F.col("s") <= F.col("n") / 2, F.col("s") * 5).otherwise((F.col("n") - F.col("s")) * 5) + F.pmod("event_id", F.lit(3)))


@query(f"""with e as (select *, row_number() {_W}) * 1.0 as r, count(*) over (partition by user_id) as n from {_E}),
a as (select user_id, event_id, cast(r as double) as s, case when r <= n / 2 then r * 5 else (n - r) * 5 end + event_id % 3 as alt from e),
sl as (select *, count(*) {_W} rows between 8 preceding and current row) as c, regr_slope(alt, s) {_W} rows between 8 preceding and current row) as k,
  max(alt) {_W} rows between 8 preceding and current row) as pk from a),
pk as (select x.user_id, x.event_id, x.s, x.k, x.pk, (select min(y.s) from a y where y.user_id = x.user_id and y.s between x.s - 8 and x.s and y.alt = x.pk) as ps from sl x where c = 9),
h as (select *, max(case when k > 1 then 1 else 0 end) over (partition by user_id order by s rows unbounded preceding) as up,
  sum(case when k < -2 then 1 else 0 end) over (partition by user_id order by s rows between 2 preceding and current row) as dn from pk)
select user_id, min(s) as detected_s, arg_min(ps, s) as peak_s, cast(arg_min(pk, s) as double) as peak from h where up = 1 and dn = 3 group by user_id""")
def burst_detect(spark, sf):
    return series.detect_burst(_altitude(spark, sf), BY, ORDER, "alt", "s").select("user_id", "detected_s", "peak_s", F.col("peak").cast("double").alias("peak"))


@query("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, date_trunc('hour', ts), event_type order by ts, event_id) r from events) where r = 1")
def dedup_keep_first(spark, sf):
    e = read(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return series.keep_first(e, ["user_id", "hour", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("select user_id, sum(case when value < p then 1 else 0 end)::bigint as inversions from (select *, lag(value) over (partition by user_id order by event_id) p from events) group by user_id")
def inversion_count(spark, sf):
    return series.inversions(read(spark, sf, "events"), BY, ["event_id"], "value").groupBy("user_id").agg(F.count_if("inverted").alias("inversions"))


@query("""with p as (select event_id, json_extract_string(props, '$.k') as raw from events)
select event_id, try_cast(raw as double) as parsed, case when raw is null then 'missing' when try_cast(raw as double) is null then 'not a number' end as reject_reason from p""")
def tolerant_parse(spark, sf):
    raw = F.get_json_object("props", "$.k")
    e = read(spark, sf, "events").withColumn("raw", raw)
    return e.select("event_id", F.col("raw").try_cast("double").alias("parsed"), F.when(F.col("raw").isNull(), "missing").when(F.col("raw").try_cast("double").isNull(), "not a number").alias("reject_reason"))


@query("""with n as (select cast(p_size as double) x, avg(p_retailprice) y from part group by 1),
l as (select l_orderkey, l_linenumber, l_quantity + l_discount as place from lineitem),
i as (select x lo, lead(x) over (order by x) hi, y y0, lead(y) over (order by x) y1 from n)
select l_orderkey, l_linenumber, round(coalesce(y0 + (place - lo) / (hi - lo) * (y1 - y0), y0, (select y from n order by x limit 1)), 6) as y,
  place < (select min(x) from n) or place > (select max(x) from n) as extrapolated
from l left join i on place >= lo and (place < hi or hi is null)""")
def interp_lookup(spark, sf):
    nodes = read(spark, sf, "part").groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    out = interp.lookup(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + F.col("l_discount")).alias("place")), F.col("place"), nodes, "x", ["y"])
    return out.select("l_orderkey", "l_linenumber", F.round("y", 6).alias("y"), "extrapolated")


@query("select p_partkey, " + "case " + " ".join(f"when p_retailprice * 40 >= {h} then {k}" for k, (h, _, _) in reversed(list(enumerate(LAYERS)))) + " end as layer from part")
def band_lookup(spark, sf):
    return read(spark, sf, "part").select("p_partkey", atmos.layer_index(F.col("p_retailprice") * 40).alias("layer"))


def _points(spark, sf):
    """Line items as points: quantity and price as degrees."""
    return read(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") / 100).alias("lat"), (F.col("l_extendedprice") / 1e5).alias("lon"))


_MPD = EARTH_RADIUS_M * math.pi / 180
_ELL = f"""with p as (select l_returnflag, l_quantity / 100 lat, l_extendedprice / 1e5 lon from lineitem),
c as (select l_returnflag, avg(lat) clat, avg(lon) clon, count(*) n from p group by 1),
q as (select p.*, c.clat, c.clon, c.n, (lon - clon) * {_MPD!r} * cos(radians(clat)) e, (lat - clat) * {_MPD!r} m from p join c using (l_returnflag)),
v as (select l_returnflag, clat, clon, n, var_samp(e) ee, var_samp(m) nn, covar_samp(e, m) en from q group by all),
t as (select *, (ee + nn) / 2 + sqrt(greatest(0, ((ee + nn) / 2) ** 2 - (ee * nn - en * en))) top, (ee + nn) / 2 - sqrt(greatest(0, ((ee + nn) / 2) ** 2 - (ee * nn - en * en))) low from v),
el as (select l_returnflag, clat, clon, n, sqrt(-2 * ln(0.05)) * sqrt(top) ma, sqrt(-2 * ln(0.05)) * sqrt(greatest(0, low)) mi, (degrees(atan2(en, top - ee)) + 360) % 180 az from t)"""


@query(_ELL + " select l_returnflag, round(clat, 6) centre_lat, round(clon, 6) centre_lon, n, round(ma, 3) semi_major_m, round(mi, 3) semi_minor_m, round(az, 5) azimuth_deg from el")
def ellipse(spark, sf):
    e = el.fit(_points(spark, sf), ["l_returnflag"])
    return e.select("l_returnflag", *[F.round(c, d).alias(c) for c, d in (("centre_lat", 6), ("centre_lon", 6))], "n", *[F.round(c, d).alias(c) for c, d in (("semi_major_m", 3), ("semi_minor_m", 3), ("azimuth_deg", 5))])


@query(_ELL + """ select l_returnflag, round(avg(case when ((e * sin(radians(az)) + m * cos(radians(az))) / ma) ** 2 + ((e * cos(radians(az)) - m * sin(radians(az))) / mi) ** 2 <= 1 then 1.0 else 0.0 end), 4) contained
from q join el using (l_returnflag) group by 1""")
def containment(spark, sf):
    p = _points(spark, sf)
    return el.containment(p, el.fit(p, ["l_returnflag"]), ["l_returnflag"]).select("l_returnflag", F.round("contained", 4).alias("contained"))


@query("""with g as (select l_returnflag, l_extendedprice v, sum(l_quantity) w from lineitem group by 1, 2),
c as (select *, sum(w) over (partition by l_returnflag order by v) / sum(w) over (partition by l_returnflag) c from g)
select l_returnflag, min(case when c >= 0.05 then v end) q05, min(case when c >= 0.5 then v end) q50, min(case when c >= 0.95 then v end) q95 from c group by 1""")
def weighted_quantile(spark, sf):
    return weights.weighted_quantiles(read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")


@query("""with w as (select l_linenumber, exp(l_discount) / sum(exp(l_discount)) over (partition by l_linenumber) w from lineitem)
select l_linenumber, round(sum(w), 6) total, round(1 / sum(w * w), 3) ess from w group by 1""")
def log_normalise_ess(spark, sf):
    w = weights.log_normalise(read(spark, sf, "lineitem").select("l_linenumber", "l_discount"), ["l_linenumber"], "l_discount")
    return w.groupBy("l_linenumber").agg(F.round(F.sum("w"), 6).alias("total"), F.round(weights.effective_size(), 3).alias("ess"))


@query("""with b as (select s_suppkey, s_nationkey, cast(round((s_acctbal + 1000) * 100) as bigint) k from supplier),
c as (select *, count(*) over (partition by s_nationkey) n, sum(k) over (partition by s_nationkey order by s_suppkey) c, sum(k) over (partition by s_nationkey) t, lead(1) over (partition by s_nationkey order by s_suppkey) nx from b),
u as (select *, case when nx is null then n - 1 else least(n - 1, cast(floor(n * (c / t) - 0.25) as bigint)) end hi from c),
l as (select *, coalesce(lag(hi) over (partition by s_nationkey order by s_suppkey), -1) lo from u)
select s_suppkey, unnest(range(1, cast(hi - lo + 1 as bigint)))::int as copy from l where hi > lo""")
def systematic_resample(spark, sf):
    b = read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.round((F.col("s_acctbal") + 1000) * 100).cast("long").alias("k"))
    return weights.resample(b, ["s_nationkey"], ["s_suppkey"], "k", 0.25).select("s_suppkey", "copy")


@query("""with w as (select l_returnflag, l_linenumber, l_tax v, l_quantity / sum(l_quantity) over (partition by l_returnflag, l_linenumber) w from lineitem)
select l_returnflag, round(sum(w * v) / count(distinct l_linenumber), 6) mean_tax from w group by 1""")
def mixture_pool(spark, sf):
    own = Window.partitionBy("l_returnflag", "l_linenumber")
    w = read(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_tax", (F.col("l_quantity") / F.sum("l_quantity").over(own)).alias("w"))
    return weights.pool(w, ["l_returnflag"], "l_linenumber").groupBy("l_returnflag").agg(F.round(F.sum(F.col("w") * F.col("l_tax")), 6).alias("mean_tax"))


@query("select o_orderpriority, round(median(case when o_totalprice > 0 then (o_totalprice - o_custkey) / o_totalprice else 0 end), 6) as reduction from orders group by 1")
def median_reduction(spark, sf):
    o = read(spark, sf, "orders").withColumn("r", quality.error_reduction(F.col("o_totalprice"), F.col("o_custkey").cast("double")))
    return o.groupBy("o_orderpriority").agg(F.round(F.median("r"), 6).alias("reduction"))


@query(f"""with f as (select user_id, arg_min(value, (s, event_id)) frozen from {_E} group by 1)
select event_id, round(case when frozen > 0 then (frozen - value) / frozen else 0 end, 6) as reduction from events join f using (user_id)""")
def frozen_vs_live(spark, sf):
    e = events(spark, sf)
    frozen = e.groupBy("user_id").agg(F.min_by("value", F.struct("s", "event_id")).alias("frozen"))
    return e.join(frozen, "user_id").select("event_id", F.round(quality.error_reduction(F.col("frozen"), F.col("value")), 6).alias("reduction"))


@query("""with n as (select l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) net from lineitem group by 1),
c as (select o_orderpriority case_name, abs(net - o_totalprice) / abs(o_totalprice) error from orders join n on l_orderkey = o_orderkey)
select case_name, count(*) checks, 0.5 as tolerance, round(max(error), 6) worst, bool_and(error <= 0.5) passed from c group by 1""".replace("0.5 as tolerance", "cast(0.5 as double) as tolerance"))
def tolerance_suite(spark, sf):
    net = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("net"))
    joined = read(spark, sf, "orders").join(net, F.col("o_orderkey") == F.col("l_orderkey"))
    error, passed = quality.tolerance_check(F.col("net"), F.col("o_totalprice"), 0.5)
    return quality.summarise_checks(joined.select(F.col("o_orderpriority").alias("case_name"), error.alias("error"), F.lit(0.5).alias("tolerance"), passed.alias("passed"))).withColumn("worst", F.round("worst", 6))


@query("select user_id, max(case when event_type = 'click' then value end) click, max(case when event_type = 'view' then value end) as view_value from events group by 1")
def pivot_posterior(spark, sf):
    p = read(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.max("value"))
    return p.withColumnRenamed("view", "view_value")


@query(f"select user_id, arg_min(event_id, (abs(s - 1000000), s)) as event_id from {_E} group by 1")
def nearest_in_time(spark, sf):
    return interp.nearest(events(spark, sf), BY, F.col("s"), F.lit(1_000_000.0), "event_id")


_LL = "select s_suppkey, (s_suppkey * 37 % 160) - 80.0 lat1, (s_suppkey * 91 % 360) - 180.0 lon1, (s_suppkey * 53 % 160) - 80.0 lat2, (s_suppkey * 17 % 360) - 180.0 lon2 from supplier"


def _pairs(spark, sf):
    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select("s_suppkey", *[(k * a % m - b).cast("double").alias(n) for n, a, m, b in (("lat1", 37, 160, 80), ("lon1", 91, 360, 180), ("lat2", 53, 160, 80), ("lon2", 17, 360, 180))])


@query(f"""select s_suppkey, round(2 * {EARTH_RADIUS_M!r} * asin(least(1, sqrt(sin(radians(lat2 - lat1) / 2) ** 2 + cos(radians(lat1)) * cos(radians(lat2)) * sin(radians(lon2 - lon1) / 2) ** 2))), 3) as metres from ({_LL})""")
def haversine(spark, sf):
    return _pairs(spark, sf).select("s_suppkey", F.round(geo.haversine(*map(F.col, ("lat1", "lon1", "lat2", "lon2"))), 3).alias("metres"))


@query(f"""select s_suppkey, round((degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360) % 360, 6) as bearing from ({_LL})""")
def bearing(spark, sf):
    return _pairs(spark, sf).select("s_suppkey", F.round(geo.bearing(*map(F.col, ("lat1", "lon1", "lat2", "lon2"))), 6).alias("bearing"))


@query(f"""with d as (select *, asin(sin(radians(lat1)) * cos(50000 / {EARTH_RADIUS_M!r}) + cos(radians(lat1)) * sin(50000 / {EARTH_RADIUS_M!r}) * cos(radians(lon2 + 180))) b from ({_LL}))
select s_suppkey, round(degrees(b), 6) lat, round((lon1 + degrees(atan2(sin(radians(lon2 + 180)) * sin(50000 / {EARTH_RADIUS_M!r}) * cos(radians(lat1)), cos(50000 / {EARTH_RADIUS_M!r}) - sin(radians(lat1)) * sin(b))) + 540) % 360 - 180, 6) lon from d""")
def destination(spark, sf):
    lat, lon = geo.destination(F.col("lat1"), F.col("lon1"), F.col("lon2") + 180, F.lit(50_000.0))
    return _pairs(spark, sf).select("s_suppkey", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def _sql_layers(value) -> str:
    return "case " + " ".join(f"when h >= {LAYERS[k][0]} then {value(k)}" for k in range(len(LAYERS) - 1, 0, -1)) + f" else {value(0)} end"


def _sql_law(k: int) -> str:
    h0, t0, lapse = LAYERS[k]
    g = atmos._G_R
    return f"{atmos.BASE_PA[k]!r} * " + (f"exp({-g!r} * (h - {h0}) / {t0})" if lapse == 0 else f"pow({t0} / ({t0} + {lapse} * (h - {h0})), {g / lapse!r})")


_Z = f"select l_orderkey, l_linenumber, z, {POTENTIAL_RADIUS_M} * z / ({POTENTIAL_RADIUS_M} + z) h from (select l_orderkey, l_linenumber, l_extendedprice % 86000 z from lineitem)"
_STATE = f"select l_orderkey, l_linenumber, z, {_sql_layers(lambda k: f'{LAYERS[k][1]} + {LAYERS[k][2]} * (h - {LAYERS[k][0]})')} t, {_sql_layers(_sql_law)} p from ({_Z})"


@query(f"select l_orderkey, l_linenumber, round(t, 4) temperature_k, round(p, 3) pressure_pa, round(p / ({atmos.AIR_CONSTANT!r} * t), 7) density_kg_m3, round(sqrt({1.4 * atmos.AIR_CONSTANT!r} * t), 4) sound_ms from ({_STATE})")
def atmosphere(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") % 86000).alias("z"))
    return atmos.with_state(li, F.col("z")).select("l_orderkey", "l_linenumber", *[F.round(c, d).alias(c) for c, d in (("temperature_k", 4), ("pressure_pa", 3), ("density_kg_m3", 7), ("sound_ms", 4))])


@query(f"select l_orderkey, l_linenumber, round(z, 4) altitude_m from ({_Z})")
def pressure_altitude(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") % 86000).alias("z"))
    return atmos.with_state(li, F.col("z")).select("l_orderkey", "l_linenumber", F.round(atmos.pressure_altitude(F.col("pressure_pa")), 4).alias("altitude_m"))


@query("""with w as (select l_orderkey, l_linenumber, -l_quantity * sin(radians(l_discount * 3600)) e, -l_quantity * cos(radians(l_discount * 3600)) n from lineitem)
select l_orderkey, l_linenumber, round(e, 6) + 0 east_ms, round(n, 6) + 0 north_ms, round(sqrt(e * e + n * n), 6) speed_ms from w""")
def wind_components(spark, sf):
    east, north = geo.wind_components(F.col("l_discount") * 3600, F.col("l_quantity"))
    w = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", east.alias("e"), north.alias("n"))
    speed, _ = geo.wind_polar(F.col("e"), F.col("n"))
    return w.select("l_orderkey", "l_linenumber", (F.round("e", 6) + 0).alias("east_ms"), (F.round("n", 6) + 0).alias("north_ms"), F.round(speed, 6).alias("speed_ms"))


@query("select p_partkey, round(case p_size % 4 when 0 then p_retailprice * 0.3048 when 1 then p_retailprice when 2 then p_retailprice * 1000 end, 6) as metres from part")
def quantity_parse(spark, sf):
    text = F.concat(F.col("p_retailprice").cast("string"), F.element_at(F.array(F.lit(" ft"), F.lit(""), F.lit(" km"), F.lit(" furlong")), F.col("p_size") % 4 + 1))
    return read(spark, sf, "part").select("p_partkey", F.round(units.parse_quantity(text, LENGTH_M, "m"), 6).alias("metres"))


@query("select event_id, (case when value < 10 then 2 else 0 end | case when event_type = 'click' then 1 else 0 end)::int as flags from events")
def flags(spark, sf):
    f = quality.set_flag(F.lit(0), quality.DROPOUT, F.col("value") < 10)
    return read(spark, sf, "events").select("event_id", quality.set_flag(f, quality.INVERTED, F.col("event_type") == "click").alias("flags"))


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 40)")
def idempotent_ingest(spark, sf):
    stored = read(spark, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return quality.new_rows(read(spark, sf, "orders").select("o_orderkey"), stored, ["o_orderkey"])


@query("select p_partkey, sha256(p_partkey::varchar || '|' || p_name || '|' || p_size::varchar) as digest from part")
def config_hash(spark, sf):
    return read(spark, sf, "part").select("p_partkey", quality.identity("p_partkey", "p_name", "p_size").alias("digest"))


@query(f"select event_id from (select event_id, row_number() {_W}) r from {_E}) where (r - 1) % 10 = 0")
def stride_sample(spark, sf):
    return series.stride(events(spark, sf), BY, ORDER, 10).select("event_id")


@query(f"""with recursive e as (select user_id, s from {_E}), f(user_id, s) as (
  select user_id, min(s) from e group by 1 union all
  select f.user_id, (select min(e.s) from e where e.user_id = f.user_id and e.s - f.s >= 250000) from f where exists (select 1 from e where e.user_id = f.user_id and e.s - f.s >= 250000))
select user_id, s as fired_s from f""")
def greedy_throttle(spark, sf):
    return series.throttle(events(spark, sf), BY, "s", 250_000.0)


@query("select event_type, count(distinct ts) updates from events group by 1")
def count_distinct_updates(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("ts").alias("updates"))


@query("select event_type, max(ts) latest, count(*) n from events group by 1")
def latest_epoch(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.max("ts").alias("latest"), F.count("*").alias("n"))


@query("select event_type, count(*) filter (where value > 50) failed from events group by 1")
def failed_checks(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("failed"))


@query("select s_suppkey, d as dim, r as stratum, 1::bigint as n from supplier, range(5) a(d), range(20) b(r)")
def lhs_strata(spark, sf):
    """A design of 20 members for each supplier: one in each stratum."""
    u = sample.designs(read(spark, sf, "supplier"), ["s_suppkey"], 20, 5, F.col("s_suppkey"))
    return u.select("s_suppkey", "dim", F.floor(F.col("u") * 20).alias("stratum")).groupBy("s_suppkey", "dim", "stratum").agg(F.count("*").alias("n"))


def _drawn(spark, sf):
    """A member for each supplier, its parameters drawn from the marginals before a flight."""
    from . import sim

    k = F.col("s_suppkey")
    drawn = [d.quantile_column(sample.uniform(7, F.lit(name), k)).alias(name) for name, d in sim.Config().dispersion()]
    return read(spark, sf, "supplier").select(k.cast("long").alias("member"), *drawn).repartition(spark.sparkContext.defaultParallelism)


@query()
def simulate_flight(spark, sf):
    from . import sim

    return sim.simulate(_drawn(spark, sf), sim.Config(), sim.Settings())


@query()
def landing_footprint(spark, sf):
    from . import sim

    e = sim.simulate(_drawn(spark, sf), sim.Config(), sim.Settings(step_s=0.5)).where("status = 'OK'")
    return el.fit(e.select(F.lit(1).alias("run_id"), "lat", "lon"), ["run_id"])


def _flight_log(spark, sf, config, settings, every: int):
    """A flight's log whose altitudes stray as the values of events do."""
    from . import sim

    noise = read(spark, sf, "events").groupBy((F.col("event_id") % 1000).alias("n")).agg(((F.avg("value") - 50) / 10).alias("stray"))
    log = sim.synthetic_log(spark, config, settings, seed=5, every=every).withColumn("n", (F.col("packet_id") % 1000).cast("long"))
    return log.join(noise, "n", "left").withColumn("alt_m", F.col("alt_m") + F.coalesce("stray", F.lit(0.0))).drop("n", "stray")


@query()
def filter_bank(spark, sf):
    from . import bank, sim

    log = _flight_log(spark, sf, sim.Config(), sim.Settings(step_s=0.5), 120)
    return bank.run(log, sim.Config(), sim.Settings(step_s=0.5), filters=4, particles=25)


from . import queries_domain, queries_reports, queries_series  # noqa: E402,F401  they register their queries
