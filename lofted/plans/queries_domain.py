"""Driver queries: readers, sinks, stored tables, simulation and scoring, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import atmos, gauss, geo, units
from ..functions.constants import CELSIUS_ZERO_K, EARTH_RADIUS_M, KNOT_MS, LAYERS, LENGTH_M, POTENTIAL_RADIUS_M, STANDARD_GRAVITY
from ..operators import ellipse as el
from ..operators import interp, quality, series, weights
from ..sources import frames, sinks, text
from ..sources.store import Store, assemble, duplicates, shared_root
from . import replay, sim, validate
from .queries import _ELL, _LL, _MPD, _Z, _E, _STATE, _flight_log, _pairs, _points, _sql_law, _sql_layers, events, query, read

# ---- readers: a telemetry file per hundred events, a sounding per size of part, a JSON document per supplier

_TOKENS = """(select event_id, 'log-' || (event_id // 100) as file, event_id % 100 + 3 as line, (event_id % 100) % 90 as packet_id,
  cast(floor(epoch(ts)) as bigint) - (event_id % 4) * 600 as s, event_id % 13 = 0 as bad, round(value - 45, 2) as lat, round(user_id * 2.5 - 180, 1) as lon,
  case when event_id % 7 in (0, 1, 2) then null else round(value * 100, 1) end as alt, event_id % 21 = 3 as junk,
  case when event_id % 5 = 0 then null when event_id % 25 = 1 then -5 when event_id % 17 = 0 then 300000 else 20000 + 100 * floor(value) end as p from events)"""


def _sql_altitude(p: str) -> str:
    """Altitude of a pressure by each layer's inverse."""
    cases = []
    for k, (h0, t0, lapse) in enumerate(LAYERS):
        rise = f"{-t0 / atmos._G_R!r} * ln({p} / {atmos.BASE_PA[k]!r})" if lapse == 0 else f"{t0 / lapse!r} * (pow({p} / {atmos.BASE_PA[k]!r}, {-lapse / atmos._G_R!r}) - 1)"
        h = f"({h0} + {rise})"
        z = f"{POTENTIAL_RADIUS_M} * {h} / ({POTENTIAL_RADIUS_M} - {h})"
        cases.append(f"when {p} > {atmos.BASE_PA[k + 1]!r} then {z}" if k + 1 < len(LAYERS) else f"else {z}")
    return "case " + " ".join(cases) + " end"


_REASON = """case when bad then 'epoch_utc is no instant' when not lat between -90 and 90 then 'lat out of range' when not lon between -180 and 180 then 'lon out of range'
  when junk then 'alt_gps_m is no number' when p <= 0 then 'pressure_pa must be positive' end"""
_TELEMETRY = f"""t as (select *, {_REASON} as reason from {_TOKENS}),
v as (select *, row_number() over (partition by file, packet_id order by line) as n from t where reason is null),
k as (select *, case when alt is null and p is not null and p < 177000 then {_sql_altitude('p')} end as derived, lag(s) over (partition by file order by line) as before from v where n = 1),
f as (select file, line, packet_id, s, lat, lon, coalesce(alt, derived) as alt_m, (case when s < before then 1 else 0 end + case when alt is null then 2 else 0 end + case when derived is not null then 4 else 0 end)::int as flags, alt is null and p is not null and derived is null as outside from k)"""


def _log_lines(spark, sf):
    """The text of the telemetry files, line by line."""
    e = read(spark, sf, "events").withColumn("file", F.concat(F.lit("log-"), F.floor(F.col("event_id") / 100).cast("string")))
    k, mod = F.col("event_id"), lambda n: F.col("event_id") % n
    at = F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) - mod(4) * 600)
    stamp = F.concat(F.replace(F.substring(at.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.when(mod(11) == 0, "").otherwise("Z"))
    alt = F.when(mod(21) == 3, "junk").when(mod(7) == 0, "nan").when(mod(7) == 1, " - ").when(mod(7) == 2, "").otherwise(F.format_string("%.1f", F.col("value") * 100))
    p = F.when(mod(5) == 0, "").when(mod(25) == 1, "-5").when(mod(17) == 0, "300000").otherwise(F.format_string("%.0f", (20000 + 100 * F.floor("value")).cast("double")))
    cells = [F.when(mod(13) == 0, "soon").otherwise(stamp), ((k % 100) % 90).cast("string"), F.format_string("%.2f", F.col("value") - 45), F.format_string("%.1f", F.col("user_id") * 2.5 - 180), alt, p, F.lit("x")]
    rows = e.select("file", (mod(100) + 3).cast("int").alias("line"), F.concat_ws(",", *cells).alias("text"))
    heads = e.select("file").distinct().select("file", F.explode(F.array(*[F.struct(F.lit(n).alias("line"), F.lit(t).alias("text")) for n, t in ((1, "# telemetry"), (2, "Time,seq, Latitude,lon,altitude,pressure,extra"))])).alias("h")).select("file", "h.line", "h.text")
    return rows.unionByName(heads)


@query(f"with {_TELEMETRY} select file, packet_id::int as packet_id, s as epoch_s, lat, lon, round(alt_m, 3) as alt_m, flags, row_number() over (partition by file order by s, packet_id)::int as place from f")
def telemetry_scan(spark, sf):
    samples, _ = text.parse_telemetry(_log_lines(spark, sf))
    return text.in_order(samples).select("file", "packet_id", F.unix_seconds("epoch_utc").alias("epoch_s"), "lat", "lon", F.round("alt_m", 3).alias("alt_m"), "flags", "place")


@query(f"with {_TELEMETRY} select file, line::int as line, reason from t where reason is not null union all select file, line::int, 'duplicate packet_id' from v where n > 1 union all select file, line::int, 'pressure_pa is outside the model' from f where outside")
def telemetry_rejects(spark, sf):
    return text.parse_telemetry(_log_lines(spark, sf))[1].select("file", "line", "reason")


@query(f"""with {_TELEMETRY}, r as (select file, 'x' as reason from t where reason is not null union all select file, 'x' from f where outside)
select file, count(*) as kept, count(*) filter (where flags & 1 <> 0) as inverted, count(*) filter (where flags & 2 <> 0) as dropouts, count(*) filter (where flags & 4 <> 0) as from_pressure,
  (select count(*) from v where v.file = f.file and n > 1) as duplicates, (select count(*) from r where r.file = f.file) as rejected from f group by file""")
def telemetry_summary(spark, sf):
    return text.anomaly_summary(*text.parse_telemetry(_log_lines(spark, sf)))


_SOUNDING = f"""l as (select 's-' || p_size as file, p_partkey + 10 as line, 'ST' || p_size as station, round(p_retailprice, 1) * 100 as pressure_pa, (p_partkey % 60) * 100.0 as height_gpm,
  case when p_partkey % 19 = 0 then -200 else p_size - 60 end + {CELSIUS_ZERO_K} as temperature_k, (p_partkey * 7 % 360) as dir, (p_partkey % 80) * {KNOT_MS!r} as speed,
  case when p_partkey % 29 = 0 then 'fewer than eight fields' when p_partkey % 23 = 0 then 'not a number' when p_partkey % 19 = 0 then 'not temperature_k between 150 and 340' end as reason from part),
g as (select *, row_number() over (partition by file, height_gpm order by line) as r from l where reason is null)"""


def _sounding_lines(spark, sf):
    p = read(spark, sf, "part")
    mod = lambda n: F.col("p_partkey") % n
    number = lambda c: F.format_string("%.1f", c.cast("double"))
    cells = [number(F.col("p_retailprice")), number(mod(60) * 100), F.when(mod(19) == 0, "-200.0").otherwise(number(F.col("p_size") - 60))]
    rest = [F.lit("0.0"), F.lit("50"), F.lit("1.0"), F.when(mod(23) == 0, "calm").otherwise((F.col("p_partkey") * 7 % 360).cast("string")), mod(80).cast("string"), F.lit("300.1")]
    line = F.when(mod(29) == 0, F.concat_ws("  ", *cells, *rest[:2])).otherwise(F.concat_ws("   ", F.lit(""), *cells, *rest))
    file = F.concat(F.lit("s-"), F.col("p_size").cast("string"))
    rows = p.select(file.alias("file"), (F.col("p_partkey") + 10).cast("int").alias("line"), line.alias("text"))
    heads = ((1, F.concat(F.lit("  Station identifier: ST"), F.col("p_size").cast("string"))), (2, F.lit("-" * 40)), (3, F.lit("PRES HGHT TEMP DWPT RELH MIXR DRCT SKNT")), (4, F.lit("")))
    top = p.select("p_size").distinct().select(file.alias("file"), F.explode(F.array(*[F.struct(F.lit(n).alias("line"), t.alias("text")) for n, t in heads])).alias("h")).select("file", "h.line", "h.text")
    return rows.unionByName(top)


@query(f"with {_SOUNDING} select file, station, height_gpm, pressure_pa, round(temperature_k, 3) as temperature_k, round(-speed * sin(radians(dir)), 6) + 0 as wind_u_ms, round(-speed * cos(radians(dir)), 6) + 0 as wind_v_ms from g where r = 1")
def sounding_scan(spark, sf):
    levels, _ = text.parse_sounding(_sounding_lines(spark, sf))
    return levels.select("file", "station", "height_gpm", F.round("pressure_pa", 3).alias("pressure_pa"), F.round("temperature_k", 3).alias("temperature_k"), *[(F.round(c, 6) + 0).alias(c) for c in ("wind_u_ms", "wind_v_ms")])


@query(f"with {_SOUNDING} select file, line::int as line, reason from l where reason is not null union all select file, line::int, 'repeated height' from g where r > 1")
def sounding_rejects(spark, sf):
    return text.parse_sounding(_sounding_lines(spark, sf))[1].select("file", "line", "reason")


@query("""select s_suppkey, case s_suppkey % 7 when 0 then 'free_lift_kg is required' when 1 then 'ascent_cd must be a number' when 2 then 'gas must be one of HELIUM, HYDROGEN' when 3 then 'name is required' when 4 then 'not valid JSON' end as error,
  case when s_suppkey % 7 not in (0, 4) then 1.0 + s_suppkey / 100 end as free_lift_kg, case s_suppkey % 7 when 4 then null when 2 then 'NEON' else 'HELIUM' end as gas from supplier""")
def config_scan(spark, sf):
    k = F.col("s_suppkey")
    lift = F.when(k % 7 == 0, "").otherwise(F.format_string('"free_lift_kg": %.2f, ', 1.0 + k / 100))
    name, drag, gas = F.when(k % 7 == 3, " ").otherwise("b"), F.when(k % 7 == 1, '"0.45"').otherwise("0.45"), F.when(k % 7 == 2, "neon").otherwise("helium")
    whole = F.concat(F.lit('{"name": "'), name, F.lit('", '), lift, F.lit('"payload_mass_kg": 1.2, "envelope_mass_kg": 1.2, "launch_diameter_m": 1.8, "burst_diameter_m": 7, "ascent_cd": '), drag, F.lit(', "chute_area_m2": 1.0, "chute_cd": 1.4, "gas": "'), gas, F.lit('"}'))
    docs = read(spark, sf, "supplier").select("s_suppkey", F.when(k % 7 == 4, '{"name": ').otherwise(whole).alias("text"))
    return text.parse_balloons(docs).select("s_suppkey", "error", "free_lift_kg", "gas")


@query("select s_suppkey, case when s_suppkey % 2 = 0 then 0.5 else 0.25 end as step_s, 'RK4' as integrator, 21600.0::double as t_end_s, case when s_suppkey % 3 = 0 then 5 else 10 end as state_sample_stride from supplier".replace("0.5 else 0.25 end", "0.5::double else 0.25::double end"))
def settings_scan(spark, sf):
    k = F.col("s_suppkey")
    parts = F.concat_ws(", ", F.when(k % 2 == 0, '"step_s": 0.5'), F.when(k % 3 == 0, '"state_sample_stride": 5'))
    docs = read(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit('{"name": "m", "sim": {'), parts, F.lit("}}")).alias("text"))
    return text.parse_settings(docs).drop("text")


@query("select n_name as name, n_nationkey * 7919::bigint as seed, '2026-09-14T04:30:00Z' as launch_epoch_utc from nation")
def csv_tables(spark, sf):
    where = f"{shared_root(spark)}/seeds"
    rows = read(spark, sf, "nation").select(F.concat_ws(",", "n_name", (F.col("n_nationkey") * 7919).cast("string"), F.lit("2026-09-14T04:30:00Z")).alias("value"))
    head = spark.range(1).select(F.explode(F.array(F.lit("# seeds"), F.lit("name,seed,launch_epoch_utc"))).alias("value"))
    head.coalesce(1).unionByName(rows).coalesce(1).write.text(where)
    return text.read_table_csv(spark, where, "name string, seed long, launch_epoch_utc string")


@query("select page_id, sha256(html) as digest from pages")
def file_digest(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.digest(F.col("html").cast("binary")).alias("digest"))


# ---- stored tables


def _states(spark, sf):
    """Orders as states of runs: run_id, member_index, t_s and the rest."""
    o = read(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 50).cast("long").alias("run_id"), (F.col("o_orderkey") % 7).alias("member_index"), F.col("o_orderkey").cast("double").alias("t_s"), F.when(F.col("o_orderkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("alt_m"), F.when(F.col("o_orderstatus") == "F", "DESCENT").otherwise("ASCENT").alias("phase"), (F.col("o_orderkey") % 5 == 0).cast("int").alias("wind_extrapolated"))


_STORED = "(select o_custkey % 50 as run_id, o_orderkey % 7 as member_index, o_orderkey::double as t_s, case when o_orderkey % 11 = 0 then null else o_totalprice end as alt_m, case when o_orderstatus = 'F' then 'DESCENT' else 'ASCENT' end as phase, o_orderkey % 5 = 0 as wind_extrapolated from orders)"


@query(f"select run_id, member_index, t_s, alt_m, phase, wind_extrapolated, row_number() over (order by t_s) as place from {_STORED} where run_id = 7 and member_index < 5")
def store_scan(spark, sf):
    store = Store(spark, shared_root(spark))
    store.insert("run_state", _states(spark, sf))
    own = store.scan("run_state", (F.col("run_id") == 7) & (F.col("member_index") < 5), ("run_id", "t_s"))
    return series.placed(own, ["run_id"], ["t_s"]).select("run_id", "member_index", "t_s", "alt_m", "phase", "wind_extrapolated", "place")


@query(f"select member_index, t_s, alt_m from {_STORED} where run_id = 3 and phase = 'ASCENT' and alt_m is null")
def store_find(spark, sf):
    store = Store(spark, shared_root(spark))
    store.insert("run_state", _states(spark, sf))
    return store.find("run_state", run_id=3, phase="ASCENT", alt_m=None).select("member_index", "t_s", "alt_m")


@query("select row_number() over (order by s_suppkey) + 25 as id, s_name as name, s_nationkey::bigint as mission_id from supplier")
def store_insert_keyed(spark, sf):
    store = Store(spark, shared_root(spark))
    nations, suppliers = read(spark, sf, "nation"), read(spark, sf, "supplier")
    store.insert_keyed("flight_log", nations.select(F.col("n_nationkey").alias("mission_id"), F.col("n_name").alias("name")), ["mission_id", "name"])
    rows = suppliers.select(F.col("s_nationkey").cast("long").alias("mission_id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("sample_count"))
    return store.insert_keyed("flight_log", rows, ["sample_count"]).select("id", "name", "mission_id")


def _runs(store, spark, sf):
    s = read(spark, sf, "supplier")
    store.insert("run", s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("mission_id"), F.lit("RUNNING").alias("status")))
    store.insert("run_state", _states(spark, sf))


@query("select s_suppkey as id, case when s_suppkey = 7 then 'OK' else 'RUNNING' end as status, case when s_suppkey = 7 then 1234::bigint end as wall_clock_ms from supplier")
def store_update(spark, sf):
    store = Store(spark, shared_root(spark))
    _runs(store, spark, sf)
    store.finish_run(7, "OK", 1234)
    return store.read("run").select("id", "status", "wall_clock_ms")


@query(f"select 'run' as name, count(*) as n from supplier where s_suppkey not in (3, 5) union all select 'run_state', count(*) from {_STORED} where run_id not in (3, 5)")
def store_delete(spark, sf):
    store = Store(spark, shared_root(spark))
    _runs(store, spark, sf)
    store.delete("run", spark.createDataFrame([(3,), (5,)], "id long"))
    count = lambda t: store.read(t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
    return count("run").unionByName(count("run_state"))


@query("select o_custkey, count(*) as n from orders group by 1 having count(*) > 1")
def store_duplicates(spark, sf):
    return duplicates(read(spark, sf, "orders"), ["o_custkey"])


@query("select s_suppkey, count(l_partkey) as levels, coalesce(string_agg(p, ',' order by l_quantity, l_orderkey, l_linenumber), '') as prices from supplier left join (select l_suppkey, l_partkey, l_quantity, l_orderkey, cast(cast(l_quantity as int) as varchar) as p, l_linenumber from lineitem) on l_suppkey = s_suppkey group by 1")
def sounding_assembly(spark, sf):
    li = read(spark, sf, "lineitem").withColumn("p", F.col("l_quantity").cast("int").cast("string"))
    out = assemble(read(spark, sf, "supplier").select("s_suppkey"), li, "s_suppkey", "l_suppkey", "l_quantity", ["l_orderkey", "l_linenumber", "p"])
    return out.select("s_suppkey", F.size("levels").cast("long").alias("levels"), F.concat_ws(",", F.transform("levels", lambda x: x["p"])).alias("prices"))


# ---- files


def _flights(spark, sf):
    """Line items as states of flights: an order is a flight, its lines are the states."""
    li = read(spark, sf, "lineitem")
    phase = F.when(F.col("l_linenumber") == 3, "BURST").when(F.col("l_linenumber") > 3, "DESCENT").otherwise("ASCENT")
    return li.select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") * 10).cast("double").alias("s"), (F.col("l_quantity") / 4).alias("lat"), (F.col("l_discount") * 100).alias("lon"), F.col("l_extendedprice").alias("alt_m"), (F.col("l_tax") * 10).alias("vz_ms"), F.lit(2.5).alias("diameter_m"), phase.alias("phase"), (F.col("l_returnflag") == "A").alias("wind_extrapolated"), F.col("l_partkey").alias("part"))


_FLIGHT = "(select l_orderkey as run_id, l_linenumber * 10.0 as s, l_quantity / 4 as lat, l_discount * 100 as lon, l_extendedprice as alt_m, l_tax * 10 as vz_ms, case when l_linenumber = 3 then 'BURST' when l_linenumber > 3 then 'DESCENT' else 'ASCENT' end as phase, l_returnflag = 'A' as wind_extrapolated, l_partkey as part from lineitem)"


@query(f"select run_id, printf('%.3f', s::double) as s, printf('%.7f', lat) as lat, printf('%.7f', lon) as lon, printf('%.3f', alt_m) as alt_m, printf('%.4f', vz_ms) as vz_ms, '2.5000' as diameter_m, phase, case when wind_extrapolated then '1' else '0' end as wind_extrapolated from {_FLIGHT}")
def trajectory_csv(spark, sf):
    where = f"{shared_root(spark)}/trajectory"
    sinks.write_csv(sinks.trajectory_rows(_flights(spark, sf)), where)
    return spark.read.csv(where, header=True, schema="run_id long, s string, lat string, lon string, alt_m string, vz_ms string, diameter_m string, phase string, wind_extrapolated string")


def _members(spark, sf):
    o = read(spark, sf, "orders")
    status = F.when(F.col("o_orderkey") % 9 == 0, "ALOFT").otherwise("OK")
    return o.select(F.col("o_orderkey").alias("member"), (F.col("o_custkey") / 64).alias("lat"), (F.col("o_custkey") / 32).alias("lon"), F.col("o_totalprice").alias("burst_alt_m"), *[F.lit(v).alias(c) for c, v in (("free_lift_kg", 1.1), ("ascent_cd", 0.45), ("burst_diameter_m", 7.0), ("chute_cd", 1.4), ("wind_scale", 1.0))], status.alias("status"), F.col("o_orderpriority").alias("run"), F.col("o_totalprice").alias("alt_m"), (F.col("o_totalprice") / 10).alias("landing_s"))


@query("""select o_orderkey as member, case when o_orderkey % 9 = 0 then '' else printf('%.7f', o_custkey / 64) end as lat, case when o_orderkey % 9 = 0 then '' else printf('%.7f', o_custkey / 32) end as lon, case when o_orderkey % 9 = 0 then '' else printf('%.1f', o_totalprice) end as burst_alt_m,
  '1.100000' as free_lift_kg, '0.450000' as ascent_cd, '7.000000' as burst_diameter_m, '1.400000' as chute_cd, '1.000000' as wind_scale, case when o_orderkey % 9 = 0 then 'FAILED' else 'OK' end as status from orders""".replace("printf('%.1f', o_totalprice)", "printf('%.1f', round(o_totalprice, 1))"))
def scatter_csv(spark, sf):
    own = _members(spark, sf).withColumn("burst_alt_m", F.round("burst_alt_m", 1))
    return sinks.scatter_rows(own)


@query(_ELL + f" select l_returnflag as run_id, '0.9500' as confidence, printf('%.7f', clat) as centre_lat, printf('%.7f', clon) as centre_lon, printf('%.2f', ma) as semi_major_m, printf('%.2f', mi) as semi_minor_m, printf('%.3f', az) as azimuth_deg, printf('%.4f', {math.pi!r} * ma * mi / 1e6) as area_km2, cast(n as varchar) as member_count from el")
def ellipse_csv(spark, sf):
    return sinks.ellipse_rows(el.fit(_points(spark, sf), ["l_returnflag"]).withColumnRenamed("l_returnflag", "run_id"))


@query(_ELL + f" select l_returnflag, round({math.pi!r} * ma * mi / 1e6, 4) as area_km2, round(ma / mi, 6) as aspect from el")
def ellipse_area(spark, sf):
    return el.fit(_points(spark, sf), ["l_returnflag"]).select("l_returnflag", F.round(el.area_m2() / 1e6, 4).alias("area_km2"), F.round(el.aspect(), 6).alias("aspect"))


_SUMMARY = f"(select run_id, max(alt_m) as apogee_m, max(s) as duration_s, max(case when phase = 'BURST' then alt_m end) as burst_alt_m, max(case when phase = 'BURST' then s end) as burst_s, count(*) filter (where wind_extrapolated) as wind_held, count(*) as states from {_FLIGHT} group by 1)"


@query(f"select run_id, apogee_m, duration_s::double as duration_s, burst_alt_m, burst_s::double as burst_s, wind_held, states from {_SUMMARY}")
def trajectory_summary(spark, sf):
    return series.summary(_flights(spark, sf), ["run_id"]).drop("landing_lat", "landing_lon")


@query(f"select run_id, coalesce(printf('%.1f', round(burst_alt_m, 1)), '') as burst_alt_m, coalesce(printf('%.1f', burst_s::double), '') as burst_s, '' as landing_lat, '' as landing_lon, printf('%.1f', duration_s::double) as duration_s, printf('%.1f', round(apogee_m, 1)) as apogee_m, cast(states as varchar) as states, cast(wind_held as varchar) as wind_held from {_SUMMARY}")
def run_summary_csv(spark, sf):
    own = series.summary(_flights(spark, sf), ["run_id"])
    return sinks.summary_rows(own.withColumns({c: F.round(c, 1) for c in ("burst_alt_m", "apogee_m")}))


@query("select s_name as name, cast(s_suppkey as varchar) as seed, printf('%.6f', s_acctbal / 1000) as free_lift_kg, '0.450000' as ascent_cd, '7.000000' as burst_diameter_m, '1.400000' as chute_cd, '1.000000' as wind_scale, printf('%.1f', 30000.5 + s_suppkey) as burst_alt_m, printf('%.7f', s_suppkey / 8) as landing_lat, printf('%.7f', s_suppkey / 4) as landing_lon, cast(s_nationkey as varchar) as sample_count from supplier")
def manifest_csv(spark, sf):
    k = F.col("s_suppkey")
    truths = read(spark, sf, "supplier").select(F.col("s_name").alias("name"), k.alias("seed"), (F.col("s_acctbal") / 1000).alias("free_lift_kg"), F.lit(0.45).alias("ascent_cd"), F.lit(7.0).alias("burst_diameter_m"), F.lit(1.4).alias("chute_cd"), F.lit(1.0).alias("wind_scale"), (30000.5 + k).alias("burst_alt_m"), (k / 8).alias("landing_lat"), (k / 4).alias("landing_lon"), F.col("s_nationkey").alias("sample_count"))
    return sinks.manifest_rows(truths)


@query("select s_suppkey, '{\"seed\":' || s_suppkey || ',\"burst_epoch_utc\":' || case when s_suppkey % 2 = 0 then 'null' else '\"2026-09-14T05:00:00Z\"' end || ',\"sample_count\":' || s_nationkey || '}' as truth_json from supplier")
def truth_json(spark, sf):
    k = F.col("s_suppkey")
    own = read(spark, sf, "supplier").select("s_suppkey", k.alias("seed"), F.when(k % 2 == 1, "2026-09-14T05:00:00Z").alias("burst_epoch_utc"), F.col("s_nationkey").alias("sample_count"))
    return sinks.truth_json(own, "seed", "burst_epoch_utc", "sample_count").select("s_suppkey", "truth_json")


@query("select 'f' as flight, event_id as packet_id, strftime(to_timestamp(1704067200 + event_id) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.000Z') as epoch_utc, printf('%.6f', user_id / 8) as lat, printf('%.6f', user_id / 4) as lon, case when event_id % 5 = 0 then '' else printf('%.1f', user_id / 2) end as alt_gps_m, '95000.0' as pressure_pa, '288.00' as temperature_k from events")
def telemetry_csv(spark, sf):
    k, u = F.col("event_id"), F.col("user_id")
    own = read(spark, sf, "events").select(F.lit("f").alias("flight"), k.alias("packet_id"), F.timestamp_seconds(1704067200 + k).alias("epoch_utc"), (u / 8).alias("lat"), (u / 4).alias("lon"), F.when(k % 5 != 0, u / 2).alias("alt_m"), F.lit(95000.0).alias("pressure_pa"), F.lit(288.0).alias("temperature_k"))
    return sinks.telemetry_rows(own)


@query(_ELL + f""", k as (select l_returnflag, clat, clon, ma, mi, radians(az) as a, unnest(range(73)) as i from el),
corners as (select *, ma * cos(2 * {math.pi!r} * (i % 72) / 72) as u, mi * sin(2 * {math.pi!r} * (i % 72) / 72) as v from k)
select l_returnflag, i::int as vertex, round(clon + (u * sin(a) + v * cos(a)) / ({_MPD!r} * cos(radians(clat))), 6) as lon, round(clat + (u * cos(a) - v * sin(a)) / {_MPD!r}, 6) as lat from corners""")
def ellipse_ring(spark, sf):
    e = el.fit(_points(spark, sf), ["l_returnflag"])
    return e.select("l_returnflag", F.posexplode(el.ring()).alias("vertex", "p")).select("l_returnflag", "vertex", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query("""select 'r' as run, 'member' as kind, '{"type":"Feature","properties":{"name":"member ' || o_orderkey || '"},"geometry":{"type":"Point","coordinates":[' || printf('%.7f', o_custkey / 32) || ',' || printf('%.7f', o_custkey / 64) || ',' || printf('%.1f', round(o_totalprice, 1)) || ']}}' as feature from orders where o_orderkey % 9 <> 0""")
def footprint_members(spark, sf):
    own = _members(spark, sf).withColumn("run", F.lit("r")).withColumn("alt_m", F.round("alt_m", 1))
    fitted = el.fit(own, ["run"])
    return sinks.footprint_features(fitted, own, ["run"]).where("kind = 'member'")


@query(f"""select run_id, '{{"type":"FeatureCollection","features":[{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[' || string_agg('[' || lon || ',' || lat || ',' || part || ']', ',' order by s, lon, lat, part) || ']}},"properties":{{"kind":"track"}}}}' ||
  coalesce(string_agg(',{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || lon || ',' || lat || ',' || part || ']}},"properties":{{"kind":"burst"}}}}', '' order by s, lon, lat, part) filter (where phase = 'BURST'), '') || ']}}' as value
from (select run_id, s, phase, part % 90 as lat, part % 180 as lon, part from {_FLIGHT}) group by 1""")
def flight_geojson(spark, sf):
    own = _flights(spark, sf).select("run_id", "s", (F.col("part") % 90).alias("lat"), (F.col("part") % 180).alias("lon"), F.col("part").alias("alt_m"), "phase")
    return sinks.flight_geojson(own)


@query("with n as (select l_orderkey, sum(l_extendedprice) as net from lineitem group by 1), c as (select o_orderpriority as case_name, abs(net - o_totalprice) / o_totalprice as error from orders join n on l_orderkey = o_orderkey) select case_name, printf('  %-10s %3d checks, tolerance %.3f%% worst %.5f%% %s', case_name, count(*), 50.0::double, max(error) * 100, case when max(error) <= 0.5 then 'PASS' else 'FAIL' end) as line from c group by 1")
def console_checks(spark, sf):
    net = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("net"))
    joined = read(spark, sf, "orders").join(net, F.col("o_orderkey") == F.col("l_orderkey"))
    error, passed = quality.tolerance_check(F.col("net"), F.col("o_totalprice"), 0.5)
    checks = joined.select(F.col("o_orderpriority").alias("case_name"), error.alias("error"), F.lit(0.5).alias("tolerance"), passed.alias("passed"))
    return sinks.console_checks(quality.summarise_checks(checks))


# ---- data of plots


@query(f"select run_id as member_index, s::double / 60 as minutes, alt_m / 1000 as km, phase = 'BURST' as is_burst from {_FLIGHT}")
def altitude_frame(spark, sf):
    return frames.altitude(_flights(spark, sf).withColumnRenamed("run_id", "member_index"))


@query(_ELL + " select l_returnflag, round(e / 1000, 4) as east_km, round(m / 1000, 4) as north_km from q")
def footprint_frame(spark, sf):
    p = _points(spark, sf)
    return frames.footprint(p, el.centroid(p, ["l_returnflag"]), ["l_returnflag"]).select("l_returnflag", F.round("east_km", 4).alias("east_km"), F.round("north_km", 4).alias("north_km"))


@query("with b as (select min(l_quantity) as x0, max(l_quantity) as x1, min(l_discount) as y0, max(l_discount) as y1 from lineitem), h as (select *, greatest(x1 - x0, y1 - y0) * 0.62::double as half from b) select round((x0 + x1) / 2 - half, 6) as x_min, round((x0 + x1) / 2 + half, 6) as x_max, round((y0 + y1) / 2 - half, 6) as y_min, round((y0 + y1) / 2 + half, 6) as y_max from h")
def equal_scale_frame(spark, sf):
    return sinks.plot_frame(read(spark, sf, "lineitem"), "l_quantity", "l_discount").select(*[F.round(c, 6).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])


@query("select 'p' || (s_suppkey % 4) as param, s_suppkey / 60 as minutes, s_acctbal as median, s_acctbal - 1 as low, s_acctbal + 2 as high, case s_suppkey % 4 when 1 then 1.5::double end as truth from supplier")
def posterior_frame(spark, sf):
    k = F.col("s_suppkey")
    own = read(spark, sf, "supplier").select(F.concat(F.lit("p"), (k % 4).cast("string")).alias("param"), k.alias("s"), F.col("s_acctbal").alias("q50"), (F.col("s_acctbal") - 1).alias("q05"), (F.col("s_acctbal") + 2).alias("q95"))
    return frames.posterior(own, {"p1": 1.5})


def _haversine(a: str, b: str, c: str, d: str) -> str:
    return f"2 * {EARTH_RADIUS_M!r} * asin(least(1, sqrt(sin(radians({c} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2)))"


_SCORED = f"""u as (select user_id, s, event_id, (event_id * 37 % 1700) / 10 - 85 as la, (event_id * 91 % 3500) / 10 - 175 as lo, value * 1e5 as sm, case when event_id % 3 = 0 then 0.5 else 0.95 end as conf from {_E}),
z as (select user_id, s, {_haversine('(user_id % 80)', '(user_id % 170)', '10', '20')} as frozen, {_haversine('la', 'lo', '10', '20')} as err, sm, s >= 1000000 + user_id as after from u where conf = 0.95)"""


def _scored(spark, sf):
    k = F.col("event_id")
    own = events(spark, sf).select("user_id", "s", (k * 37 % 1700 / 10 - 85).alias("centre_lat"), (k * 91 % 3500 / 10 - 175).alias("centre_lon"), (F.col("value") * 1e5).alias("semi_major_m"), F.when(k % 3 == 0, 0.5).otherwise(0.95).alias("confidence"), (1_000_000 + F.col("user_id")).alias("burst_s"))
    users = own.select("user_id").distinct()
    frozen = users.select("user_id", (F.col("user_id") % 80).alias("centre_lat"), (F.col("user_id") % 170).alias("centre_lon"), F.lit(0.95).alias("confidence"))
    return replay.score(own, frozen, users.select("user_id", F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon")), ["user_id"])


@query(f"with {_SCORED} select user_id, s, round(frozen, 2) as frozen_error_m, round(err, 2) as error_m, sm as semi_major_m, after as after_burst, err <= sm as inside, round(case when frozen > 0 then (frozen - err) / frozen else 0 end, 6) as reduction from z")
def score_replay(spark, sf):
    return _scored(spark, sf).withColumns({"frozen_error_m": F.round("frozen_error_m", 2), "error_m": F.round("error_m", 2), "reduction": F.round("reduction", 6)})


@query(f"with {_SCORED}, e as (select user_id, max(s) as end_s from z group by 1) select user_id, round(arg_min(err, s) filter (where after), 2) as at_burst_m, round(arg_min(err, abs(s - end_s / 2)), 2) as at_fraction_m, round(arg_max(err, s), 2) as last_m, round(any_value(frozen), 2) as frozen_error_m from z join e using (user_id) group by 1")
def score_moments(spark, sf):
    out = replay.moments(_scored(spark, sf), ["user_id"])
    return out.select("user_id", *[F.round(c, 2).alias(c) for c in ("at_burst_m", "at_fraction_m", "last_m", "frozen_error_m")])


@query(f"with {_SCORED} select user_id, round(s / 60, 4) as minutes, round(frozen / 1000, 4) as frozen_km, round(err / 1000, 4) as live_km, round(sm / 1000, 4) as claimed_km, after as after_burst from z")
def error_frame(spark, sf):
    out = frames.error(_scored(spark, sf), ["user_id"])
    return out.withColumns({"minutes": F.round("minutes", 4), **{c: F.round(c, 4) for c in ("frozen_km", "live_km", "claimed_km")}})


def _sql_contained(level: float) -> str:
    k = math.sqrt(-2 * math.log(1 - level)) / math.sqrt(-2 * math.log(0.05))
    return f"avg(case when ((e * sin(radians(az)) + m * cos(radians(az))) / (ma * {k!r})) ** 2 + ((e * cos(radians(az)) - m * sin(radians(az))) / (mi * {k!r})) ** 2 <= 1 then 1.0 else 0.0 end)"


@query(_ELL + " select * from (" + " union all ".join(f"select l_returnflag, {c}::double as nominal, round({_sql_contained(c)}, 4) as empirical, round({_sql_contained(c)} - {c}, 4) as gap from q join el using (l_returnflag) group by 1" for c in (0.5, 0.95)) + ")")
def calibration_frame(spark, sf):
    p = _points(spark, sf)
    both = [el.containment(p, el.fit(p, ["l_returnflag"], c), ["l_returnflag"]) for c in (0.5, 0.95)]
    out = frames.calibration(both[0].unionByName(both[1]), ["l_returnflag"])
    return out.withColumns({"empirical": F.round("empirical", 4), "gap": F.round("gap", 4)})


_RESIDUAL = f"""with r as (select z, t, p, p / ({atmos.AIR_CONSTANT!r} * t) as d, round(t, 1) as t0, round(p, 4) as p0, round(p / ({atmos.AIR_CONSTANT!r} * t), 8) as d0 from ({_STATE}))
select z as altitude_m, q as quantity, round((m - f) / f * 100, 6) + 0.0::double as percent, abs((m - f) / f) <= 0.001 as within from (select z, 'temperature_k' as q, t as m, t0 as f from r union all select z, 'pressure_pa', p, p0 from r union all select z, 'density_kg_m3', d, d0 from r)"""


@query(_RESIDUAL)
def residual_frame(spark, sf):
    return frames.residual(_reference(spark, sf)).withColumn("percent", F.round("percent", 6) + F.lit(0.0))


def _reference(spark, sf):
    """A reference table: the model at some altitudes, rounded as printed tables are."""
    li = read(spark, sf, "lineitem").select((F.col("l_extendedprice") % 86000).alias("altitude_m"))
    return atmos.with_state(li, F.col("altitude_m")).select("altitude_m", F.round("temperature_k", 1).alias("temperature_k"), F.round("pressure_pa", 4).alias("pressure_pa"), F.round("density_kg_m3", 8).alias("density_kg_m3"))


@query(f"select quantity, round(max(abs(percent)), 4) as worst_percent, count(*) filter (where not within) as failed from ({_RESIDUAL}) group by 1")
def worst_drift(spark, sf):
    return frames.residual(_reference(spark, sf)).groupBy("quantity").agg(F.round(F.max(F.abs("percent")), 4).alias("worst_percent"), F.count_if(~F.col("within")).alias("failed"))


# ---- units, vectors, rules


@query(f"select p_partkey, round(p_size * case p_size % 3 when 0 then 0.3048 when 1 then 1852.0 else 1609.344 end, 6) as length_m, round(p_size * 0.45359237, 6) as mass_kg, round((p_retailprice - 32) * 5 / 9 + {CELSIUS_ZERO_K}, 6) as temperature_k, p_retailprice * 100 as pressure_pa from part")
def unit_conversion(spark, sf):
    size, price = F.col("p_size"), F.col("p_retailprice")
    unit = F.when(size % 3 == 0, "ft").when(size % 3 == 1, "nmi").otherwise("mi")
    return read(spark, sf, "part").select("p_partkey", F.round(units.length_m(size, unit), 6).alias("length_m"), F.round(units.mass_kg(size, F.lit("lb")), 6).alias("mass_kg"), F.round(units.temperature_k(price, F.lit("F")), 6).alias("temperature_k"), units.pressure_pa(price, F.lit("hPa")).alias("pressure_pa"))


@query(f"select l_orderkey, l_linenumber, round(h, 6) as geopotential_m, round({POTENTIAL_RADIUS_M} * h / ({POTENTIAL_RADIUS_M} - h), 4) as geometric_m from ({_Z})")
def geopotential(spark, sf):
    h = atmos.geopotential(F.col("l_extendedprice") % 86000)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(h, 6).alias("geopotential_m"), F.round(atmos.geometric(h), 4).alias("geometric_m"))


@query("select l_orderkey, l_linenumber, l_quantity * 1.5 as x, l_discount * 1.5 as y, round(l_quantity + 0.25 * l_discount, 6) as stage from lineitem")
def vector_scale(spark, sf):
    v = F.zip_with(F.array("l_quantity", "l_discount"), F.array(F.lit(1.5), F.lit(1.5)), lambda a, b: a * b)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", v[0].alias("x"), v[1].alias("y"), F.round(F.col("l_quantity") + 0.25 * F.col("l_discount"), 6).alias("stage"))


@query("select l_orderkey, l_linenumber, 4.0 between l_quantity / 10 and l_quantity / 5 as covers, l_quantity / 5 - l_quantity / 10 as width, l_quantity < 100 / 10 as degenerate from lineitem")
def band_flags(spark, sf):
    q = F.col("l_quantity")
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", weights.covers(F.lit(4.0), q / 10, q / 5).alias("covers"), weights.width(q / 10, q / 5).alias("width"), weights.degenerate(q, F.lit(100.0)).alias("degenerate"))


@query("select event_id, value - 45 between -90 and 90 and user_id * 2.5 - 180 between -180 and 180 as ok from events")
def coordinate_rules(spark, sf):
    return read(spark, sf, "events").select("event_id", geo.valid_point(F.col("value") - 45, F.col("user_id") * 2.5 - 180).alias("ok"))


@query("""select s_suppkey, case when s_acctbal <= 0 then 'free_lift_kg' else '' end || case when s_suppkey % 10 > 7 then case when s_acctbal <= 0 then ',' else '' end || 'burst_diameter_m' else '' end as reasons from supplier where s_acctbal <= 0 or s_suppkey % 10 > 7""")
def config_rules(spark, sf):
    own = read(spark, sf, "supplier").select("s_suppkey", F.lit("b").alias("name"), *[F.lit(v).alias(c) for c, v in (("payload_mass_kg", 1.2), ("envelope_mass_kg", 1.2), ("chute_area_m2", 1.0), ("ascent_cd", 0.45), ("chute_cd", 1.4), ("burst_diameter_m", 7.0))], (F.col("s_suppkey") % 10).cast("double").alias("launch_diameter_m"), F.col("s_acctbal").alias("free_lift_kg"), F.lit("helium").alias("gas"))
    own = own.withColumn("launch_diameter_m", F.when(F.col("s_suppkey") % 10 > 7, 8.0).otherwise(1.8))
    return quality.split_by_rules(own, quality.balloon_rules())[1].select("s_suppkey", F.concat_ws(",", "reasons").alias("reasons"))


@query("select p_partkey from part where p_partkey % 5 = 0")
def tamper_check(spark, sf):
    own = read(spark, sf, "part").withColumn("config_hash", quality.identity("p_partkey", "p_name"))
    stored = own.withColumn("p_name", F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))
    return quality.tampered(stored, "config_hash", "p_partkey", "p_name").select("p_partkey")


@query("select o_orderpriority as run, count(*) filter (where o_orderkey % 9 <> 0) as landed from orders group by 1")
def succeeded_members(spark, sf):
    return _members(spark, sf).where("status = 'OK'").groupBy("run").agg(F.count("*").alias("landed"))


@query("select count(*) as members, count(*) filter (where o_orderkey % 9 = 0) as failed, round(avg(case when o_orderkey % 9 = 0 then 1.0 else 0.0 end), 6) as failure_rate, count(*) filter (where o_orderkey % 9 = 0) <= greatest(1, count(*) // 100) as within_budget, round(avg(o_totalprice) filter (where o_orderkey % 9 <> 0), 2) as mean_burst_alt_m, round(avg(o_totalprice / 10) filter (where o_orderkey % 9 <> 0), 2) as mean_flight_s from orders")
def ensemble_counts(spark, sf):
    out = sinks.summary(_members(spark, sf))
    return out.withColumns({"failure_rate": F.round("failure_rate", 6), "mean_burst_alt_m": F.round("mean_burst_alt_m", 2), "mean_flight_s": F.round("mean_flight_s", 2)})


@query("select o_orderpriority as run, o_orderkey as member from orders where o_orderkey < 20")
def keep_members(spark, sf):
    return _members(spark, sf).where(F.col("member") < 20).select("run", "member")


# ---- joins, aggregates and sequences


@query("select o_orderpriority, count(*) as flights, count(*) filter (where truth between o_totalprice * 0.05 and o_totalprice * 0.5) as covered, count(*) filter (where abs(truth - o_totalprice) <= 50000) as recovered from orders join (select l_orderkey, max(l_extendedprice) as truth from lineitem group by 1) on l_orderkey = o_orderkey group by 1")
def recovery_coverage(spark, sf):
    truth = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("truth"))
    o = F.col("o_totalprice")
    bands = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", (o * 0.05).alias("low"), (o * 0.5).alias("high"), o.alias("median"))
    return quality.recovery(bands, truth, ["o_orderkey"], ["o_orderpriority"], 50_000.0)


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_extendedprice >= 40000 qualify row_number() over (partition by l_orderkey order by l_linenumber, l_extendedprice) = 1")
def first_above(spark, sf):
    return series.first_above(read(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_extendedprice"], "l_extendedprice", 40_000.0, ["l_linenumber", "l_extendedprice"])


@query("""with m as (select l_returnflag, sum(l_quantity) as w, sum(l_quantity * l_discount) / sum(l_quantity) as md, sum(l_quantity * l_tax) / sum(l_quantity) as mt from lineitem group by 1)
select l_returnflag, round(any_value(md), 8) as mean_d, round(any_value(mt), 8) as mean_t, round(sum(l_quantity * (l_discount - md) ** 2) / any_value(w), 10) as dd, round(sum(l_quantity * (l_discount - md) * (l_tax - mt)) / any_value(w), 9) as dt, round(sum(l_quantity * (l_tax - mt) ** 2) / any_value(w), 10) as tt from lineitem join m using (l_returnflag) group by 1""")
def weighted_covariance(spark, sf):
    own = read(spark, sf, "lineitem").select("l_returnflag", F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_quantity").alias("w"))
    out = weights.moments(own, ["l_returnflag"], ["d", "t"])
    return out.select("l_returnflag", F.round("mean_d", 8).alias("mean_d"), F.round("mean_t", 8).alias("mean_t"), F.round("cov_d_d", 10).alias("dd"), F.round("cov_d_t", 9).alias("dt"), F.round("cov_t_t", 10).alias("tt"))


@query("select o_orderpriority, round(regr_slope(ln(sd), ln(n)), 6) as slope, round(max(sd / mean), 6) as cv from (select o_orderpriority, o_custkey % 40 as g, count(*)::double as n, stddev_samp(o_totalprice) as sd, avg(o_totalprice) as mean from orders group by 1, 2) group by 1")
def sampler_scatter(spark, sf):
    own = read(spark, sf, "orders").select("o_orderpriority", (F.col("o_custkey") % 40).alias("g"), "o_totalprice")
    each = weights.scatter(own, ["o_orderpriority", "g"], "o_totalprice")
    return each.groupBy("o_orderpriority").agg(F.round(weights.convergence("n", "sd"), 6).alias("slope"), F.round(F.max("cv"), 6).alias("cv"))


@query("with f as (select l_orderkey as u, l_linenumber as filter_id, sum(l_quantity * l_tax * 1.2345678) / sum(l_quantity) as r, max(l_partkey) as i from lineitem group by 1, 2) select u as update_id, round(avg(r), 6) as mean_rate, sum(i)::bigint as impossible from f group by 1")
def bank_rates(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("update_id"), F.col("l_linenumber").alias("filter_id"), F.col("l_quantity").alias("w"), (F.col("l_tax") * 1.2345678).alias("rate"), F.col("l_partkey").alias("impossible"))
    each = li.groupBy("update_id", "filter_id").agg((F.sum(F.col("w") * F.col("rate")) / F.sum("w")).alias("rate"), F.max("impossible").alias("impossible"))
    return each.groupBy("update_id").agg(F.round(F.avg("rate"), 6).alias("mean_rate"), F.sum("impossible").alias("impossible"))


@query("select user_id, round(max(s) - min(s), 3) as lag_s from (select *, row_number() over (partition by user_id order by s, event_id) as r from " + _E + ") where r in (1, 4) group by 1 having count(*) = 2")
def detection_lag(spark, sf):
    own = series.placed(events(spark, sf), ["user_id"], ["s", "event_id"])
    both = own.groupBy("user_id").agg(F.max(F.when(F.col("place") == 1, F.col("s"))).alias("peak_s"), F.max(F.when(F.col("place") == 4, F.col("s"))).alias("detected_s"))
    return both.where("detected_s is not null").select("user_id", F.round(series.lag_s(), 3).alias("lag_s"))


@query(f"""with recursive a as (select user_id, s, s = max(s) over (partition by user_id) or event_id % 97 = 0 as f, value from {_E}), e as (select user_id, s, f from a where value > 55),
r(user_id, s) as (select user_id, min(s) from e group by 1 union all
  select r.user_id, (select min(e.s) from e where e.user_id = r.user_id and e.s > r.s and (e.s - r.s >= 250000 or e.f)) from r where exists (select 1 from e where e.user_id = r.user_id and e.s > r.s and (e.s - r.s >= 250000 or e.f)))
select user_id, s as fired_s from r""")
def repredict_times(spark, sf):
    own = events(spark, sf).select("user_id", "s", F.col("value").alias("alt_m"), (F.col("event_id") % 97 == 0).alias("burst"))
    return replay.due_updates(own, ["user_id"], 250_000.0, 5.0)


@query("select 'a' as case_name, s_acctbal as error from supplier union all select 'b', c_acctbal from customer")
def pooled_checks(spark, sf):
    one = read(spark, sf, "supplier").select(F.lit("a").alias("case_name"), F.col("s_acctbal").alias("error"))
    return one.unionByName(read(spark, sf, "customer").select(F.col("c_acctbal").alias("error"), F.lit("b").alias("case_name")))


@query("select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_orderdate desc, o_orderkey) as place from orders")
def ordered_scan(spark, sf):
    return series.placed(read(spark, sf, "orders"), ["o_orderpriority"], [F.desc("o_orderdate"), "o_orderkey"]).select("o_orderkey", "o_orderpriority", F.col("place").cast("long").alias("place"))


@query("select event_type, min(event_id) as event_id from events where value > 100 group by 1")
def first_match(spark, sf):
    return read(spark, sf, "events").where("value > 100").groupBy("event_type").agg(F.min_by("event_id", "event_id").alias("event_id"))


# ---- normal distribution

_ERF = "(2 / sqrt(pi()) * list_sum(list_transform(range(45), lambda n: pow(-1, n) * pow({x}, 2 * n + 1) / (gamma(n + 1) * (2 * n + 1)))))"


@query("select s_suppkey, round((1 + " + _ERF.format(x="(s_acctbal / 2500 / sqrt(2))") + ") / 2, 9) as p, round((1 - " + _ERF.format(x="(s_acctbal / 2500 / sqrt(2))") + ") / 2, 9) as tail, round(exp(-s_acctbal / 2500 * s_acctbal / 2500 / 2) / sqrt(2 * pi()), 9) as density from supplier")
def normal_cdf(spark, sf):
    z = F.col("s_acctbal") / 2500
    return read(spark, sf, "supplier").select("s_suppkey", F.round(gauss.cdf(z), 9).alias("p"), F.round(gauss.upper_tail(z), 9).alias("tail"), F.round(gauss.pdf(z), 9).alias("density"))


@query("select s_suppkey, round((s_suppkey % 1000 + 0.5) / 1000, 9) as back from supplier")
def normal_quantile(spark, sf):
    u = (F.col("s_suppkey") % 1000 + 0.5) / 1000
    own = read(spark, sf, "supplier").select("s_suppkey", gauss.inverse_cdf(u).alias("z"))
    return own.select("s_suppkey", F.round(gauss.cdf(F.col("z")), 9).alias("back"))


@query("select s_suppkey, round(2 + (s_suppkey % 100 + 0.5) / 100 * 3, 9) as uniform, 4.5::double as fixed, round(greatest(0, least(1, (s_suppkey % 7 - 2.0) / 3)), 9) as uniform_cdf, case when s_suppkey % 7 >= 4.5 then 1.0::double else 0.0::double end as fixed_cdf from supplier")
def marginals(spark, sf):
    k = F.col("s_suppkey")
    own = read(spark, sf, "supplier")
    u, x = (k % 100 + 0.5) / 100, (k % 7).cast("double")
    flat, fixed = gauss.Distribution("uniform", low=2.0, high=5.0), gauss.Distribution("fixed", mean=4.5)
    return own.select("s_suppkey", F.round(flat.quantile_column(u), 9).alias("uniform"), fixed.quantile_column(u).alias("fixed"), F.round(flat.cdf_column(x), 9).alias("uniform_cdf"), fixed.cdf_column(x).alias("fixed_cdf"))


@query(f"""with c as (select event_id, value - 50 as ea, case when event_id % 3 > 0 then user_id / 100 end as er, value / 5 as d, event_id % 4 = 0 as b, 1.0 + event_id % 10 as dt, value * 10 as drift from events),
g as (select *, case when b then 40.0 else 10.0 end as sa from c), h as (select *, sqrt(4 + (sa * sqrt(2) / dt) ** 2) as sr, sqrt(64 + (0.2 * drift) ** 2) as sd from g)
select event_id, round(-0.5 * (ea / sa) ** 2 - ln(sa) - {0.5 * math.log(2 * math.pi)!r} + coalesce(-0.5 * (er / sr) ** 2 - ln(sr) - {0.5 * math.log(2 * math.pi)!r}, 0) - 0.5 * (d / sd) ** 2 - ln(sd) - {0.5 * math.log(2 * math.pi)!r}, 8) as log_likelihood from h""")
def likelihood(spark, sf):
    k, v = F.col("event_id"), F.col("value")
    rate = F.when(k % 3 > 0, F.col("user_id") / 100)
    return read(spark, sf, "events").select("event_id", F.round(gauss.log_likelihood(v - 50, rate, v / 5, k % 4 == 0, 1.0 + k % 10, drift=v * 10, drift_share=0.2), 8).alias("log_likelihood"))


# ---- physics, times and the flight itself

_LIFT = f"select *, {POTENTIAL_RADIUS_M} * z / ({POTENTIAL_RADIUS_M} + z) h from (select l_orderkey, l_linenumber, l_quantity / 10 as lift, l_extendedprice % 86000 z from lineitem)"
_AIR = f"select *, {_sql_layers(lambda k: f'{LAYERS[k][1]} + {LAYERS[k][2]} * (h - {LAYERS[k][0]})')} t, {_sql_layers(_sql_law)} p from ({_LIFT})"
_PHYS = f"(select *, p / ({atmos.AIR_CONSTANT!r} * t) as d, p / ({atmos.gas_constant('HELIUM')!r} * t) as g from ({_AIR}))"


@query(f"""with b as (select *, (2.4 + lift) / (d - g) as v from {_PHYS})
select l_orderkey, l_linenumber, round(1.225 * exp(-z / 8500), 9) as simple_density, round(g, 9) as gas_density, round(v * g, 6) as gas_mass_kg, round(cbrt(6 * v / pi()), 6) as diameter_m, round(pi() / 4 * cbrt(6 * v / pi()) ** 2, 5) as area_m2,
  round(-sqrt(2 * 2.4 * {STANDARD_GRAVITY} / (d * 1.4)), 6) as terminal_ms, round(sqrt(2 * lift * {STANDARD_GRAVITY} / (d * 0.45 * pi() / 4 * cbrt(6 * v / pi()) ** 2)), 6) as ascent_ms from b""")
def balloon_physics(spark, sf):
    z = F.col("z")
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") % 86000).alias("z"), (F.col("l_quantity") / 10).alias("lift"))
    own = atmos.with_state(li, z)
    gas = atmos.gas_density(F.col("pressure_pa"), F.col("temperature_k"), "HELIUM")
    own = own.withColumn("g", gas).withColumn("v", (2.4 + F.col("lift")) / (F.col("density_kg_m3") - F.col("g"))).withColumn("dia", atmos.diameter(F.col("v")))
    area, rho = atmos.frontal_area(F.col("dia")), F.col("density_kg_m3")
    return own.select("l_orderkey", "l_linenumber", F.round(atmos.exponential_density(z), 9).alias("simple_density"), F.round("g", 9).alias("gas_density"), F.round(F.col("v") * F.col("g"), 6).alias("gas_mass_kg"), F.round("dia", 6).alias("diameter_m"), F.round(area, 5).alias("area_m2"), F.round(atmos.terminal_rate(F.lit(2.4), rho, F.lit(1.4), F.lit(1.0)), 6).alias("terminal_ms"), F.round(atmos.ascent_rate(F.col("lift"), rho, F.lit(0.45), area), 6).alias("ascent_ms"))


@query(f"select s_suppkey, round(-sqrt(2 * (1 + s_suppkey / 100) * {STANDARD_GRAVITY} / ({atmos.BASE_PA[0]!r}::double / ({atmos.AIR_CONSTANT!r}::double * 288.15) * 1.4::double * (1 + s_nationkey / 10))), 9) as touchdown_ms from supplier")
def touchdown(spark, sf):
    own = read(spark, sf, "supplier")
    rate = validate.touchdown_rate(1 + F.col("s_suppkey") / 100, F.lit(1.4), 1 + F.col("s_nationkey") / 10)
    return own.select("s_suppkey", F.round(rate, 9).alias("touchdown_ms"))


@query("select event_id, epoch_us(ts) - 1704067200000000 as flight_us, epoch_us(ts) // 1000 + cast(round(value * 1000) as bigint) as shifted_ms from events")
def flight_seconds(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    shifted = F.timestamp_millis(F.floor(us / 1000).cast("long") + F.round(F.col("value") * 1000).cast("long"))
    return read(spark, sf, "events").select("event_id", (us - 1_704_067_200_000_000).alias("flight_us"), F.unix_millis(shifted).alias("shifted_ms"))


@query("select event_id, round(greatest(case when abs(value) > 0 then (value * 0.3) / 3.29 / abs(value) else 0.01 end, 0.01), 9) as sigma, round(greatest(case when user_id % 3 = 0 then 0.01 else 0.02 / 3.29 / 2 end, 0.01), 9) as least from events")
def posterior_spread(spark, sf):
    v = F.col("value")
    flat = F.when(F.col("user_id") % 3 == 0, 0.0).otherwise(2.0)
    return read(spark, sf, "events").select("event_id", F.round(replay.spread(v, v - 0.1 * v, v + 0.2 * v), 9).alias("sigma"), F.round(replay.spread(flat, F.lit(1.0), F.lit(1.02)), 9).alias("least"))


@query(f"select s_suppkey, round({_haversine('lat1', 'lon1', 'lat2', 'lon2')}, 3) as error_m from ({_LL})")
def landing_error(spark, sf):
    return _pairs(spark, sf).select("s_suppkey", F.round(geo.haversine(*map(F.col, ("lat1", "lon1", "lat2", "lon2"))), 3).alias("error_m"))


@query(_ELL + " select l_returnflag, round(ma, 3) as semi_major_m from el")
def by_confidence(spark, sf):
    p = _points(spark, sf)
    both = el.fit(p, ["l_returnflag"], 0.5).unionByName(el.fit(p, ["l_returnflag"], 0.95))
    return both.where(F.col("confidence") == 0.95).select("l_returnflag", F.round("semi_major_m", 3).alias("semi_major_m"))


_STEP, _CONFIG = 0.5, sim.Config(burst_diameter_m=2.4)


def _sql_flight() -> str:
    """The equations of a flight stepped by RK4 in a recursive query, in the lowest layer."""
    g, ra, rg = STANDARD_GRAVITY, atmos.AIR_CONSTANT, atmos.gas_constant(_CONFIG.gas)
    (_, t0, lapse), p0 = LAYERS[0], atmos.BASE_PA[0]
    lat, lon, z0 = _CONFIG.launch
    temperature = lambda z: f"({t0} + {lapse} * ({POTENTIAL_RADIUS_M} * {z} / ({POTENTIAL_RADIUS_M} + {z})))"
    pressure = lambda z: f"({p0!r} * pow({t0} / {temperature(z)}, {g / ra / lapse!r}))"
    density = lambda z: f"({pressure(z)} / ({ra!r} * {temperature(z)}))"
    volume = lambda z: f"(gas * {rg!r} * {temperature(z)} / {pressure(z)})"
    size = lambda z: f"cbrt(6 * {volume(z)} / {math.pi!r})"
    mass = f"(case when up then {_CONFIG.dry_kg!r} + gas else {_CONFIG.dry_kg!r} end)"

    def pull(z: str, v: str) -> str:
        area = f"(case when up then cd * {math.pi / 4!r} * {size(z)} ** 2 else {_CONFIG.chute_cd * _CONFIG.chute_area_m2!r} end)"
        return f"((case when up then {density(z)} * {volume(z)} * {g} else 0 end) - {mass} * {g} - 0.5 * {density(z)} * {area} * {v} * abs({v})) / {mass}"

    east, north = 12.0 / _MPD, -4.0 / _MPD
    h = _STEP
    stage = lambda n, a, inner: f"select *, z + {a} * v{n - 1} as z{n}, v + {a} * a{n - 1} as v{n}, lat + {a} * {north!r} * ws as la{n} from ({inner})"
    slope = lambda n, inner: f"select *, {pull(f'z{n}', f'v{n}')} as a{n}, {east!r} * ws / cos(radians(la{n})) as lo{n} from ({inner})"
    q = slope(1, "select *, z as z1, v as v1, lat as la1 from f where not done")
    for n, a in ((2, h / 2), (3, h / 2), (4, h)):
        q = slope(n, stage(n, a, q))
    moved = f"select *, z + {h} / 6 * (v1 + 2 * v2 + 2 * v3 + v4) as nz, v + {h} / 6 * (a1 + 2 * a2 + 2 * a3 + a4) as nv, lat + {h} * {north!r} * ws as nlat, lon + {h} / 6 * (lo1 + 2 * lo2 + 2 * lo3 + lo4) as nlon from ({q})"
    ended = f"select *, not up and nz <= {z0} as down, up and {size('nz')} >= bd as pops, case when not up and nz <= {z0} then greatest(0, least(1, (z - {z0}) / (z - nz))) else 1 end as share from ({moved})"
    air = f"({density(str(z0))} - {pressure(str(z0))} / ({rg!r} * {temperature(str(z0))}))"
    gas = f"(({_CONFIG.dry_kg!r} + lift) / {air} * {pressure(str(z0))} / ({rg!r} * {temperature(str(z0))}))"
    return f"""with recursive m as (select n_nationkey as member, 1.0 + 0.02 * n_nationkey as lift, 0.40 + 0.004 * n_nationkey as cd, {_CONFIG.burst_diameter_m!r} - 0.01 * n_nationkey as bd, 0.8 + 0.016 * n_nationkey as ws from nation),
f as (select member, {gas} as gas, cd, bd, ws, {lat!r}::double as lat, {lon!r}::double as lon, {z0!r}::double as z, 0.0::double as v, 0.0::double as t, true as up, false as done, null::double as burst_s, null::double as burst_z, 0::bigint as n from m
union all select member, gas, cd, bd, ws, lat + share * (nlat - lat), lon + share * (nlon - lon), case when down then {z0} else nz end, v + share * (nv - v), t + share * {h}, up and not pops, down, case when pops then t + {h} else burst_s end, case when pops then nz else burst_z end, n + 1 from ({ended}))
select member::bigint as member, round(lat, 7) as lat, round(lon, 7) as lon, round(t, 4) as landing_s, round(v, 5) as vz_ms, burst_s, round(burst_z, 3) as burst_alt_m, n as steps from f where done"""


@query(_sql_flight())
def flight_simulation(spark, sf):
    k = F.col("n_nationkey")
    members = read(spark, sf, "nation").select(k.cast("long").alias("member"), (1.0 + 0.02 * k).alias("free_lift_kg"), (0.40 + 0.004 * k).alias("ascent_cd"), (_CONFIG.burst_diameter_m - 0.01 * k).alias("burst_diameter_m"), F.lit(_CONFIG.chute_cd).alias("chute_cd"), (0.8 + 0.016 * k).alias("wind_scale"))
    flown = sim.simulate(members, _CONFIG, sim.Settings(step_s=_STEP))
    return flown.select("member", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round("landing_s", 4).alias("landing_s"), F.round("vz_ms", 5).alias("vz_ms"), "burst_s", F.round("burst_alt_m", 3).alias("burst_alt_m"), "steps")


@query(f"select 'atmosphere' as case_name, count(*) as checks, round(max(abs(percent)) / 100, 8) as worst, bool_and(within) as passed from ({_RESIDUAL})")
def validation_suite(spark, sf):
    """The model against a table: what the suite says of it, in numbers."""
    checks = validate.judged(validate.atmosphere_checks(_reference(spark, sf)))
    return quality.summarise_checks(checks).select("case_name", "checks", F.round("worst", 8).alias("worst"), "passed")


@query()
def evaluation_set(spark, sf):
    from . import synth

    seeds = read(spark, sf, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") + 11).alias("seed"), F.lit("2026-09-14T04:30:00Z").cast("timestamp").alias("launch_epoch_utc"))
    config, settings = sim.Config(), sim.Settings(step_s=0.5)
    log = synth.telemetry(synth.truths(seeds, config, settings), config, settings, interval_s=10.0)
    return log.groupBy("flight").agg(F.count("*").alias("samples"), F.count_if(F.col("alt_m").isNull()).alias("dropouts"), F.max("alt_m").alias("top_m"))


@query()
def replay_flight(spark, sf):
    config, settings = sim.Config(burst_diameter_m=4.0), sim.Settings(step_s=0.5)
    log = _flight_log(spark, sf, config, settings, 40)
    return replay.run(log, config, settings, filters=2, particles=60, every=4, gap_s=500.0, members=40)["ellipses"]
