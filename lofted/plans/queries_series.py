"""Driver queries: long series and files by many tasks, streams, jitter, roots and runs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import atmos, gauss, roots
from ..operators import jitter, quality, sample, series, weights
from ..sources import text
from ..sources.store import shared_root
from ..streaming import burst, due, ordered
from .provenance import Run
from .queries import ORACLE_SQL, _altitude, events, query, read
from .queries_domain import _ERF, _TELEMETRY, _log_lines

# ---- one long series

_SAW = "(select o_orderkey::double as s, (case when o_orderkey % 1000 <= 500 then o_orderkey % 1000 * 5 else (1000 - o_orderkey % 1000) * 5 end + o_custkey % 3)::double as alt from orders)"
_DETECT = """sl as (select *, count(*) over w as c, regr_slope(alt, s) over w as k, max({'v': alt, 's': -s}) over w as top from a window w as (partition by run order by s rows between 8 preceding and current row)),
h as (select *, max(case when k > 1 then 1 else 0 end) over (partition by run order by s rows unbounded preceding) as up, sum(case when k < -2 then 1 else 0 end) over (partition by run order by s rows between 2 preceding and current row) as dn from sl where c = 9)
select run, min(s) as detected_s, -arg_min(top.s, s) as peak_s, arg_min(top.v, s) as peak from h where up = 1 and dn = 3 group by run"""


def _saw(spark, sf):
    """All orders as one series that rises and falls."""
    m = F.col("o_orderkey") % 1000
    alt = F.when(m <= 500, m * 5).otherwise((1000 - m) * 5) + F.col("o_custkey") % 3
    return read(spark, sf, "orders").select(F.lit("r").alias("run"), F.col("o_orderkey").cast("double").alias("s"), alt.cast("double").alias("alt"))


@query(f"with a as (select 'r' as run, * from {_SAW}), {_DETECT}")
def burst_detect_long(spark, sf):
    """The detector over one series, dealt to tasks in blocks."""
    return series.detect_burst(_saw(spark, sf), ["run"], ["s"], "alt", "s", block=1000)


@query(f"""with a as (select 'r' as run, * from {_SAW}), {_DETECT.rsplit("select run", 1)[0]}, d as (select min(s) as detected_s, -arg_min(top.s, s) as peak_s from h where up = 1 and dn = 3)
select round(detected_s - peak_s, 6) as lag_s from d where detected_s is not null""")
def detector_lag(spark, sf):
    """Seconds from the peak to its detection, by the detector's own rows."""
    found = series.detect_burst(_saw(spark, sf), ["run"], ["s"], "alt", "s", block=2000)
    return found.select(F.round(series.lag_s(), 6).alias("lag_s"))


@query("""with recursive e as (select (l_orderkey * 8 + l_linenumber)::double as s, bool_or(l_partkey % 1009 = 0) as f from lineitem group by 1),
n as materialized (select e.s, least(coalesce(u.s, 1e18), coalesce(v.s, 1e18)) as nxt from e asof left join e u on e.s + 500 <= u.s asof left join (select s from e where f) v on e.s < v.s),
r(s) as (select min(s) from e union all select nxt from r join n using (s) where nxt < 1e18)
select s as fired_s from r where s is not null""")
def throttle_long(spark, sf):
    """All line items as one series, throttled in ranges of time side by side."""
    li = read(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("double").alias("s"), (F.col("l_partkey") % 1009 == 0).alias("f"))
    return series.throttle(li, [], "s", 500.0, F.col("f"), parts=32)


@query("select l_orderkey * 8 + l_linenumber as k, max(max(case when l_partkey % 41 = 0 then 1 else 0 end)) over (order by l_orderkey * 8 + l_linenumber rows between 2 preceding and current row) = 1 as dropped from lineitem group by 1")
def dropout_runs(spark, sf):
    """Runs of missing samples in one long series, by blocks."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    own = read(spark, sf, "lineitem").groupBy(k.alias("k")).agg(F.max((F.col("l_partkey") % 41 == 0).cast("int")).alias("began"))
    return sample.dropout_runs(own.withColumn("run", F.lit(1)), ["run"], ["k"], F.col("began") == 1, block=500).select("k", "dropped")


@query("select c_custkey, true as kept, true as near from customer")
def noisy_samples(spark, sf):
    """Customers as samples: what strays stays within eight deviations, and what is not known stays unknown."""
    c = F.col("c_custkey")
    own = read(spark, sf, "customer").select("c_custkey", (c % 80).cast("double").alias("lat"), (c % 170).cast("double").alias("lon"), F.when(c % 5 > 0, c.cast("double")).alias("alt_m"), F.lit(90_000.0).alias("pressure_pa"), F.lit(None).cast("double").alias("temperature_k"), F.lit(1).alias("run"))
    out = sample.noisy(own, ["run"], ["c_custkey"], 5, {"dropout": 0.0}, block=400)
    near = (F.abs(F.col("lat") - c % 80) < 8 * 8 / 110_000) & (F.abs(F.col("pressure_pa") / 90_000 - 1) < 0.016) & F.coalesce(F.abs(F.col("alt_m") - c) < 80, F.lit(True))
    return out.select("c_custkey", ((F.col("alt_m").isNull() == (c % 5 == 0)) & F.col("temperature_k").isNull()).alias("kept"), near.alias("near"))


# ---- streams


#: Rows in one file of a stream that is made up.
_FILE_ROWS = 1_000_000


def _arriving(rows, at, arrival, batches: int, path: str):
    """A stream of `rows`: writes them to `path` in `batches` parts by order of arrival, one
    after the other, and a last row long after all others, so that the watermark passes
    them.  A part is as many files as its rows fill, which come in one batch."""
    spark = rows.sparkSession
    # worked out once, by as many tasks as there are
    rows.withColumn("__arrival", arrival).write.parquet(f"{path}-all")
    whole = spark.read.parquet(f"{path}-all")
    low, high, count = whole.agg(F.min("__arrival"), F.max("__arrival"), F.count("*")).first()
    low, high = (0.0, 0.0) if low is None else (low, high)
    step, files = max((high - low) / batches, 1e-9), -(-count // (batches * _FILE_ROWS)) or 1
    own = whole.withColumn("__batch", F.least(F.floor((F.col("__arrival") - low) / step), F.lit(batches - 1)))
    for k in range(batches):
        own.where(F.col("__batch") == k).drop("__batch", "__arrival").repartition(files).write.parquet(f"{path}/{k:03d}")
    last = whole.agg(F.max(at).alias("at")).select((F.col("at") + F.expr("interval 400 days")).alias("at"))
    last.select(*[F.col("at").alias(f.name) if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]).coalesce(1).write.parquet(f"{path}/{batches:03d}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*")


@query(ORACLE_SQL["burst_detect"])
def stream_burst(spark, sf):
    """The detector over a stream whose rows arrive out of order; same rows as `burst_detect`."""
    rows = _altitude(spark, sf).select("user_id", F.col("event_id").alias("id"), "s", F.col("alt").cast("double").alias("alt"), F.timestamp_seconds(F.col("s").cast("long")).alias("at"))
    where = shared_root(spark)
    stream = _arriving(rows, "at", F.col("s") + F.col("id") % 7, 3, f"{where}/in")
    span = spark.read.parquet(f"{where}/in-all").agg(F.max("s")).first()[0] or 0
    made = burst.detect_ordered(stream, ["user_id"], "at", "id", "s", "alt", f"{int(span / 2) + 10} seconds")
    return burst.bursts(ordered.run(made, where), ["user_id"])


@query(ORACLE_SQL["repredict_times"])
def stream_due(spark, sf):
    """Throttled updates of a stream that arrives out of order; same rows as `repredict_times`."""
    rows = events(spark, sf).select("user_id", F.col("event_id").alias("id"), "s", F.col("value").alias("alt"), (F.col("event_id") % 97 == 0).alias("burst"), F.col("ts").cast("timestamp").alias("at"))
    where = shared_root(spark)
    stream = _arriving(rows, "at", F.col("s") + F.col("id") * 7919 % 86_400, 3, f"{where}/in")
    made = due.due_updates(stream, ["user_id"], "at", "id", "s", "alt", "burst", 250_000.0, 5.0, 100 * 86_400.0, "60 days")
    return due.fired(ordered.run(made, where), ["user_id"])


# ---- files in splits


def _log_files(spark, sf) -> str:
    """The telemetry files, written as text."""
    where = f"{shared_root(spark)}/logs"
    _log_lines(spark, sf).repartition("file").sortWithinPartitions("file", "line").select("file", "text").write.partitionBy("file").text(where)
    return where


_KEPT = "select file, line::int as line, 'kept' as reason from f"
_JUDGED = f"""with {_TELEMETRY} select file, line::int as line, reason from t where reason is not null union all select file, line::int, 'duplicate packet_id' from v where n > 1
union all select file, line::int, 'pressure_pa is outside the model' from f where outside union all {_KEPT}"""


def _named(rows):
    return rows.select(F.regexp_extract("file", "file=([^/]*)", 1).alias("file"), F.col("line").cast("int").alias("line"), "reason")


@query(_JUDGED)
def telemetry_files(spark, sf):
    """Every line of the telemetry files, read by splits, and what became of it."""
    samples, rejects = text.parse_telemetry(text.split_lines(spark, _log_files(spark, sf)), block=16)
    return _named(samples.withColumn("reason", F.lit("kept")).select("file", "line", "reason").unionByName(rejects.select("file", "line", "reason")))


@query(_JUDGED)
def telemetry_followed(spark, sf):
    """The same, the files coming as a stream."""
    where, out = _log_files(spark, sf), f"{shared_root(spark)}/followed"
    text.follow_telemetry(spark, f"{where}/*", out).awaitTermination()
    kept = spark.read.option("mergeSchema", "true").parquet(f"{out}/samples").withColumn("reason", F.lit("kept"))
    return _named(kept.select("file", "line", "reason").unionByName(spark.read.parquet(f"{out}/rejects").select("file", "line", "reason")))


_ONE = """l as (select l_orderkey * 8 + l_linenumber as k, min(l_partkey % 5000) as id, min(l_shipdate) as d, min(l_quantity) as q from lineitem group by 1),
v as (select *, row_number() over (partition by id order by k) as n from l where k % 17 <> 0),
o as (select k, id, epoch(d) as s, lag(epoch(d)) over (order by k) as before from v where n = 1)"""


@query(f"with {_ONE} select (k + 1)::int as line, id::int as packet_id, s::bigint as epoch_s, (case when s < before then 1 else 0 end + 2)::int as flags from o")
def telemetry_one_log(spark, sf):
    """All line items as one log: arrival is compared in blocks of lines, none of which holds the file."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    li = read(spark, sf, "lineitem").groupBy(k.alias("k")).agg(F.min(F.col("l_partkey") % 5000).alias("id"), F.min("l_shipdate").alias("d"))
    stamp = F.when(F.col("k") % 17 == 0, "soon").otherwise(F.concat(F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    rows = li.select(F.lit("one").alias("file"), (F.col("k") + 1).alias("line"), F.concat_ws(",", stamp, F.col("id").cast("string"), F.lit("1.5"), F.lit("2.5"), F.lit("nan")).alias("text"))
    some = read(spark, sf, "lineitem").agg(F.count("*").alias("n")).where("n > 0")
    head = some.select(F.lit("one").alias("file"), F.lit(1).cast("long").alias("line"), F.lit("time,seq,lat,lon,alt").alias("text"))
    samples, _ = text.parse_telemetry(rows.unionByName(head), block=4096)
    return samples.select(F.col("line").cast("int").alias("line"), "packet_id", F.unix_seconds("epoch_utc").alias("epoch_s"), "flags")


# ---- particles

_DIMS = "s_suppkey, s_nationkey, s_acctbal as x, s_suppkey % 7 + s_acctbal / 4000 as y, 2.5::double as z, s_acctbal + 1000.0 as w from supplier"
_ROOT = f"""p as (select {_DIMS}), m as (select s_nationkey, sum(w) as sw, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my, 2.5::double as mz from p group by 1),
c as (select s_nationkey, any_value(mx) as mx, any_value(my) as my, any_value(mz) as mz, sum(w * (x - mx) ** 2) / any_value(sw) as xx, sum(w * (x - mx) * (y - my)) / any_value(sw) as xy, sum(w * (y - my) ** 2) / any_value(sw) as yy from p join m using (s_nationkey) group by 1),
r as (select *, sqrt(xx + 4) as lxx, xy / sqrt(xx + 4) as lyx from c), k as (select *, sqrt(greatest(0, yy - lyx * lyx)) as lyy from r)"""


def _particles(spark, sf):
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    return read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", b.alias("x"), (k % 7 + b / 4000).alias("y"), F.lit(2.5).alias("z"), (b + 1000.0).alias("w"))


@query(f"with {_ROOT} select s_nationkey, round(lxx, 5) as lxx, round(lyx, 6) as lyx, round(lyy, 5) as lyy, 0.0::double as lzz from k")
def covariance_root(spark, sf):
    """Roots of each nation's covariance, floored in x; z does not vary and is not moved."""
    out = jitter.root(weights.moments(_particles(spark, sf), ["s_nationkey"], ["x", "y", "z"]), ["x", "y", "z"], {"x": 2.0})
    return out.select("s_nationkey", F.round("root_x_x", 5).alias("lxx"), F.round("root_y_x", 6).alias("lyx"), F.round("root_y_y", 5).alias("lyy"), F.round("root_z_z", 6).alias("lzz"))


_A, _KERNEL = jitter.shrinkage(0.98)


@query(f"""with {_ROOT}, b as (select *, sum(w) over (partition by s_nationkey order by s_suppkey) as cw, sum(w) over (partition by s_nationkey) as t, count(*) over (partition by s_nationkey) as n, row_number() over (partition by s_nationkey order by s_suppkey) as i from p),
u as (select *, case when i = n then n - 1 else least(n - 1, floor(n * (cw / t) - 0.5)) end as hi, case when i = 1 then -1 else least(n - 1, floor(n * ((cw - w) / t) - 0.5)) end as lo from b),
j as (select s_suppkey, s_nationkey, x, y, z, unnest(range(1, cast(hi - lo + 1 as bigint)))::int as copy from u where hi > lo),
g as (select *, (s_suppkey % 5 - 2.0) / 2 as n1, (copy % 3 - 1.0) as n2 from j)
select s_suppkey, copy, round(greatest(-900, least(9000, {_A!r} * x + {1 - _A!r} * mx + {_KERNEL!r} * lxx * n1)), 4) as x, round({_A!r} * y + {1 - _A!r} * my + {_KERNEL!r} * (lyx * n1 + lyy * n2), 6) as y, round({_A!r} * z + {1 - _A!r} * mz, 6) as z from g join k using (s_nationkey)""")
def jittered(spark, sf):
    """Each nation's particles, resampled by weight and jittered with given noise."""
    noise = {"x": (F.col("s_suppkey") % 5 - 2.0) / 2, "y": F.col("copy") % 3 - 1.0, "z": F.lit(1.0)}
    out = jitter.liu_west(_particles(spark, sf), ["s_nationkey"], ["s_suppkey"], ["x", "y", "z"], 1, "w", 0.98, 0.5, {"x": 2.0}, {"x": (-900.0, 9000.0)}, noise)
    return out.select("s_suppkey", "copy", F.round("x", 4).alias("x"), F.round("y", 6).alias("y"), F.round("z", 6).alias("z"))


@query("select l_orderkey, l_linenumber, round((l_partkey % 97 + 0.5) / 97, 6) as u, true as beyond from lineitem")
def censored_redraw(spark, sf):
    """Draws of a burst diameter beyond what each envelope has reached, out to 50 deviations;
    the share of the cut distribution under each draw is the number it was drawn with."""
    u, reached, mean, sd = (F.col("l_partkey") % 97 + 0.5) / 97, F.col("l_quantity"), 5.0, 0.9
    own = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", reached.alias("reached"), gauss.truncated(u, mean, sd, 1.0, math.inf, reached).alias("x"))
    low, x = (F.greatest(F.lit(1.0), F.col("reached")) - mean) / sd, (F.col("x") - mean) / sd
    # far out both tails underflow; their ratio does not
    share = F.when(low < 30, 1 - gauss.upper_tail(x) / gauss.upper_tail(low)).otherwise(-F.expm1((low - x) * (low + x) / 2))
    return own.select("l_orderkey", "l_linenumber", F.round(share, 6).alias("u"), (F.col("x") >= F.col("reached")).alias("beyond"))


@query("select p_partkey, round(p_retailprice * 40, 5) as altitude_m from part")
def bisected_altitude(spark, sf):
    """The altitude of each pressure, by halving 0 to 86 km."""
    own = atmos.with_state(read(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") * 40).alias("z")), F.col("z"))
    log_p = F.log("pressure_pa")
    root = roots.bisect(lambda z: F.log(atmos.pressure(z)) - log_p, F.lit(-1.0), F.lit(86_000.0), 40)
    return own.select("p_partkey", F.round(root, 5).alias("altitude_m"))


@query("select l_orderkey, max(case when l_linenumber = 1 then l_extendedprice end) as free_lift_kg, max(case when l_linenumber = 2 then l_extendedprice end) as ascent_cd, 7.0 * max(case when l_linenumber = 3 then l_extendedprice end) as burst_diameter_m, 1.0::double as wind_scale from lineitem group by 1")
def median_parameters(spark, sf):
    """A flight's parameters at the posterior's medians."""
    name = F.get(F.array(F.lit("free_lift_kg"), F.lit("ascent_cd"), F.lit("burst_scale")), F.col("l_linenumber") - 1)
    own = read(spark, sf, "lineitem").groupBy("l_orderkey", name.alias("param")).agg(F.max("l_extendedprice").alias("median"))
    return weights.median_parameters(own, ["l_orderkey"], {"burst_scale": ("burst_diameter_m", 7.0)}, ["free_lift_kg", "ascent_cd", "burst_scale"]).withColumn("wind_scale", F.lit(1.0))


# ---- runs, identity and whole results


@query("select count(*) as rows, count(*) filter (where o_totalprice < 1000) as failures, greatest(1, count(*) // 100) as budget, 7::bigint as seed, case when count(*) filter (where o_totalprice < 1000) > greatest(1, count(*) // 100) then 'FAILED' else 'OK' end as status from orders")
def run_record(spark, sf):
    """What a run's record says of the rows it wrote, counted while they were written."""
    run = Run(7)
    try:
        run.write(read(spark, sf, "orders"), f"{shared_root(spark)}/run", F.col("o_totalprice") < 1000)
    except RuntimeError:
        pass  # over the budget: the record says so
    return run.table(spark).select("rows", "failures", "budget", "seed", "status")


@query("select p_partkey from part where p_partkey % 3 = 0 and p_partkey % 2 = 0")
def identity_conflicts(spark, sf):
    """Parts that are stored under their key with other contents."""
    own = read(spark, sf, "part").withColumn("digest", quality.identity("p_partkey", "p_name"))
    changed = own.withColumn("digest", F.when(F.col("p_partkey") % 3 == 0, F.sha2("digest", 256)).otherwise(F.col("digest")))
    return quality.conflicts(changed, own.where("p_partkey % 2 = 0"), ["p_partkey"], "digest").select("p_partkey")


_WHOLE = "(select l_orderkey as run_id, l_linenumber * 10.0 as s, l_quantity / 4 as lat, l_discount * 100 as lon, l_extendedprice as alt_m, case when l_linenumber = 3 then 'BURST' when l_linenumber = 5 then 'LANDED' when l_linenumber > 3 then 'DESCENT' else 'ASCENT' end as phase, l_returnflag = 'A' as wind_extrapolated from lineitem)"


@query(f"select run_id, max(alt_m) as apogee_m, max(s)::double as duration_s, max(case when phase = 'BURST' then alt_m end) as burst_alt_m, max(case when phase = 'BURST' then s end)::double as burst_s, max(case when phase = 'LANDED' then lat end) as landing_lat, max(case when phase = 'LANDED' then lon end) as landing_lon, count(*) filter (where wind_extrapolated) as wind_held, count(*) as states from {_WHOLE} group by 1")
def flight_summary(spark, sf):
    """Summaries with their landings."""
    n = F.col("l_linenumber")
    phase = F.when(n == 3, "BURST").when(n == 5, "LANDED").when(n > 3, "DESCENT").otherwise("ASCENT")
    own = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), (n * 10).cast("double").alias("s"), (F.col("l_quantity") / 4).alias("lat"), (F.col("l_discount") * 100).alias("lon"), F.col("l_extendedprice").alias("alt_m"), phase.alias("phase"), (F.col("l_returnflag") == "A").alias("wind_extrapolated"))
    return series.summary(own, ["run_id"])


_PHI = "(1 + " + _ERF.format(x="({x} / sqrt(2))") + ") / 2"


@query(f"""select s_suppkey, case when s_acctbal / 1000 < 3.5 then 0 when s_acctbal / 1000 > 6.5 then 1 else round({_PHI.format(x='(s_acctbal / 1000 - 5)')}, 8) end::double as cdf,
  round(greatest({_PHI.format(x='-1.5')}, least({_PHI.format(x='1.5')}, (s_suppkey % 100 + 0.5) / 100)), 8) as back from supplier""")
def normal_marginal(spark, sf):
    """A normal cut at 1.5 deviations: its distribution, and what its quantiles give back."""
    d, u = gauss.Distribution.symmetric(5.0, 1.0, 1.5), (F.col("s_suppkey") % 100 + 0.5) / 100
    own = read(spark, sf, "supplier").select("s_suppkey", "s_acctbal", d.quantile_column(u).alias("x"))
    return own.select("s_suppkey", F.round(d.cdf_column(F.col("s_acctbal") / 1000), 8).alias("cdf"), F.round(d.cdf_column(F.col("x")), 8).alias("back"))
