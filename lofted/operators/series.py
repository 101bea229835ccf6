"""Ordered-series operators on windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import LONG, PARTS, cut_points, range_of, running

#: Rows in one block of a long series.
BLOCK = 100_000


def finite_difference(df: DataFrame, by: list[str], order: list[str], value: str, seconds: str, out: str = "rate") -> DataFrame:
    """Two-sided difference quotient, one-sided at the ends; null if a value is
    missing or no time passes."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.lag(F.struct(value, seconds)).over(w), F.struct(value, seconds))
    after = F.coalesce(F.lead(F.struct(value, seconds)).over(w), F.struct(value, seconds))
    dt = after[seconds] - before[seconds]
    return df.withColumn(out, F.when(dt > 0, (after[value] - before[value]) / dt))


def rolling_slope(df: DataFrame, by: list[str], order: list[str], value: str, seconds: str, rows: int = 9, out: str = "slope") -> DataFrame:
    """Least-squares slope over the last `rows` rows that have a value, none before
    there are so many; 0 where time does not vary."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0)
    slope = F.coalesce(F.regr_slope(value, seconds).over(w), F.lit(0.0))
    return df.where(F.col(value).isNotNull()).withColumn(out, F.when(F.count(value).over(w) == rows, slope))


def longest(df: DataFrame, by: list[str]) -> int:
    """Rows of the longest series."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def blocks(df: DataFrame, by: list[str], order: list[str], halo: int, size: int = BLOCK) -> DataFrame:
    """`df` with each row's number in its series (__n, from 1) and its block of `size`
    rows (__block).  A block's first rows come with copies of the `halo` rows before
    them (__halo), so that a frame of `halo` rows and the row's own lies in one block,
    and a series of any length is as many tasks as it has blocks."""
    if not 0 <= halo <= size:
        raise ValueError("a block must hold the halo of the next")
    numbered = running(df, by, order, {"__n": F.lit(1).cast("long")}).drop("__n_before", "__n_total")
    block = F.floor((F.col("__n") - 1) / size)
    reach = F.when((F.col("__n") - 1) % size >= size - halo, F.array(block, block + 1)).otherwise(F.array(block))
    out = numbered.withColumn("__block", F.explode(reach))
    return out.withColumn("__halo", F.col("__block") > block)


def detect_burst(df: DataFrame, by: list[str], order: list[str], value: str, seconds: str, rows: int = 9, rise: float = 1.0, fall: float = -2.0, times: int = 3, block: int | None = None) -> DataFrame:
    """First row of each series at which `times` slopes in a row are under `fall`
    after one was over `rise`: the series' columns, detected_s, peak_s, peak.

    With `block` a series is dealt to tasks in blocks of so many rows.  What a row's
    slopes need lies in its block and the rows before it; whether the series had
    risen is one number for each series, the first row over `rise`."""
    if rows < 3 or times < 1 or not fall < 0 < rise:
        raise ValueError("a burst needs slopes over three samples or more, a confirmation, a fall under zero and a rise over it")
    known = df.where(F.col(value).isNotNull())
    if block:
        known = blocks(known, by, order, rows + times - 2, block)
        by_block, order_in = [*by, "__block"], ["__n"]
    else:
        by_block, order_in = by, order
    slopes = rolling_slope(known, by_block, order_in, value, seconds, rows)
    w = Window.partitionBy(*by_block).orderBy(*order_in)
    last = w.rowsBetween(1 - rows, 0)
    # the peak of the frame, the earliest of equal ones
    peak = F.max(F.struct(F.col(value).alias("v"), (-F.col(seconds)).alias("s"))).over(last)
    full = slopes.withColumn("__peak", peak).where("slope is not null")
    fallen = F.sum((F.col("slope") < fall).cast("int")).over(w.rowsBetween(1 - times, 0)) == times
    told = F.struct(F.col(seconds).alias("d"), "__peak")
    if block:
        marked = full.withColumn("__fallen", fallen).where(~F.col("__halo"))
        risen = marked.where(F.col("slope") > rise).groupBy(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]).agg(F.min("__n").alias("__risen"))
        same = F.col("__n") >= F.col("__risen")
        for i, c in enumerate(by):
            same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
        hits = marked.where("__fallen").join(risen, same)
        first = hits.groupBy(*by).agg(F.min_by(told, "__n").alias("b"))
    else:
        risen = F.max((F.col("slope") > rise).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
        hits = full.withColumn("__hit", risen & fallen).where("__hit")
        first = hits.groupBy(*by).agg(F.min_by(told, F.struct(*order)).alias("b"))
    return first.select(*by, F.col("b.d").alias("detected_s"), (-F.col("b.__peak.s")).alias("peak_s"), F.col("b.__peak.v").alias("peak"))


def inversions(df: DataFrame, by: list[str], arrival: list[str], value: str, out: str = "inverted") -> DataFrame:
    """Marks rows whose value is under that of the row that arrived before."""
    w = Window.partitionBy(*by).orderBy(*arrival)
    return df.withColumn(out, F.coalesce(F.col(value) < F.lag(value).over(w), F.lit(False)))


def keep_first(df: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """The first row to arrive of each key."""
    w = Window.partitionBy(*key).orderBy(*arrival)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def stride(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """Every n-th row of each series, from its first."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where((F.col("__r") - 1) % n == 0).drop("__r")


def window(by: list[str], *order: str):
    """The window of a series, in order if one is given."""
    own = Window.partitionBy(*by)
    return own.orderBy(*order) if order else own


def _jumps(s: np.ndarray, forced: np.ndarray, gap: float) -> np.ndarray:
    """For each of the sorted, distinct times of a range the index of the row that
    fires after it, were it to fire; as many as there are rows stands for none."""
    n = len(s)
    to = np.searchsorted(s, s + gap, "left")
    # s + gap may be rounded to either side of what s' - s >= gap says
    while (back := (to > 0) & (s[np.maximum(to - 1, 0)] - s >= gap)).any():
        to[back] -= 1
    while (on := (to < n) & (s[np.minimum(to, n - 1)] - s < gap)).any():
        to[on] += 1
    at = np.flatnonzero(forced)
    by_force = np.r_[at, n][np.searchsorted(at, np.arange(n), "right")]
    return np.minimum(np.maximum(to, np.arange(n) + 1), by_force)


def _enters(s: np.ndarray, forced: np.ndarray, gap: float, last: float | None) -> int:
    """Index of the first row to fire in a range that `last` came before; the length for none."""
    due = np.ones(len(s), bool) if last is None else (s - last >= gap) | (forced & (s != last))
    return int(np.argmax(due)) if due.any() else len(s)


def _summary(s: np.ndarray, forced: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """A range's fold in short.  Entered at a row up to `at[k]`, and after `at[k - 1]`,
    it leaves with `last[k]` as the last that fired; and whether its last entrance is
    forced, so that it cannot be passed by.  All that fired before did so before the
    range, so no row is the first to fire after one that is `gap` from the range's
    begin, or after a forced one."""
    to, n = _jumps(s, forced, gap), len(s)
    end = np.where(to < n, to, np.arange(n))
    while not np.array_equal(further := end[end], end):
        end = further
    far, first_forced = s - s[0] >= gap, int(np.argmax(forced)) if forced.any() else n
    count = min(n, int(np.argmax(far)) + 1 if far.any() else n, first_forced + 1)
    last = s[end[:count]]
    ends = np.flatnonzero(np.r_[last[1:] != last[:-1], True])
    return s[ends], last[ends], first_forced < count


def _leaves(at: np.ndarray, last: np.ndarray, must: bool, gap: float, state: float | None) -> float | None:
    """What a range with this summary leaves, entered with `state`."""
    if state is None:
        return float(last[0])
    due = at - state >= gap
    return float(last[np.argmax(due)]) if due.any() else float(last[-1]) if must else state


def throttle(df: DataFrame, by: list[str], seconds: str, gap: float = 50.0, force: Column | None = None, parts: int | None = None) -> DataFrame:
    """Greedy: a row fires if `gap` seconds passed since the last that fired, or if
    it is forced: by, fired_s.  Rows without seconds do not fire; of equal seconds
    one does.

    What fires depends on what fired.  Short series are gone through one by one.
    Where one has over LONG rows, time is cut into `parts` ranges: each range's
    fold is summed up by where it may be entered and when it then fired last, one
    task a series goes through these sums, and all ranges then fire side by side.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    forced = F.lit(False) if force is None else F.coalesce(force, F.lit(False))
    rows = df.select(*by, F.col(seconds).cast("double").alias("__s"), forced.alias("__f")).where("__s is not null")
    if parts is None:
        parts = PARTS if longest(rows, by) > LONG else 1
    return (_throttle_ranges(rows, by, gap, parts, kinds) if parts > 1 else _throttle_series(rows, by, gap, kinds)).withColumnRenamed("__s", "fired_s")


def _throttle_series(rows: DataFrame, by: list[str], gap: float, kinds: dict[str, str]) -> DataFrame:
    """Each task goes through its series in order of time, keeping only the last that fired."""
    dealt = (rows.repartition(*[F.col(c) for c in by]) if by else rows.coalesce(1)).sortWithinPartitions(*by, "__s", F.desc("__f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0.0
        for b in batches:
            fires = []
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(by))))) if by else [()] * b.num_rows
            for k, s, f in zip(keys, b.column(len(by)).to_pylist(), b.column(len(by) + 1).to_pylist()):
                fire = k != key or s - last >= gap or (f and s != last)
                if fire:
                    key, last = k, s
                fires.append(fire)
            yield b.select([*range(len(by)), len(by)]).filter(pa.array(fires, pa.bool_()))

    return dealt.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["__s double"]))


def _throttle_ranges(rows: DataFrame, by: list[str], gap: float, parts: int, kinds: dict[str, str]) -> DataFrame:
    names = [f"__by{i}" for i in range(len(by))]
    own = rows.select(*[F.col(c).alias(n) for c, n in zip(by, names)], "__s", "__f")
    times = own.groupBy(*names, "__s").agg(F.max("__f").alias("__f"))
    cut = times.withColumn("__range", range_of(F.col("__s"), cut_points(own, "__s", parts)).cast("int"))
    keys = ", ".join(f"`{n}` {kinds[c]}" for c, n in zip(by, names)) + (", " if by else "")

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        table = table.sort_by("__s")
        return table["__s"].to_numpy(), table["__f"].to_numpy(zero_copy_only=False).astype(bool)

    def keyed(key: tuple, like: pa.Schema, n: int, **columns: pa.Array) -> pa.Table:
        return pa.table({name: pa.array([key[i].as_py()] * n, like.field(name).type) for i, name in enumerate(names)} | columns)

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        at, last, must = _summary(*read(table), gap)
        n = len(at)
        return keyed(key, table.schema, n, __range=pa.array([key[-1].as_py()] * n, pa.int32()), at=pa.array(at), last=pa.array(last), must=pa.array([must] * n))

    def entered(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("__range", "ascending"), ("at", "ascending")])
        ranges, at, last, must = (table[c].to_numpy(zero_copy_only=False) for c in ("__range", "at", "last", "must"))
        edges = [*np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]).tolist(), len(ranges)]
        state, out = None, []
        for low, high in zip(edges, edges[1:]):
            out.append((int(ranges[low]), state))
            state = _leaves(at[low:high], last[low:high], bool(must[low]), gap, state)
        return keyed(key, table.schema, len(out), __range=pa.array([r for r, _ in out], pa.int32()), entry=pa.array([e for _, e in out], pa.float64()))

    def fired(key: tuple, table: pa.Table, entry: pa.Table) -> pa.Table:
        s, forced = read(table)
        to, at, fires = _jumps(s, forced, gap).tolist(), _enters(s, forced, gap, entry["entry"][0].as_py()), []
        while at < len(s):
            fires.append(at)
            at = to[at]
        return keyed(key, table.schema, len(fires), __s=pa.array(s[fires]))

    by_range = cut.groupBy(*names, "__range")
    sums = by_range.applyInArrow(summed, f"{keys}__range int, at double, last double, must boolean")
    states = sums.groupBy(*names).applyInArrow(entered, f"{keys}__range int, entry double")
    made = by_range.cogroup(states.groupBy(*names, "__range")).applyInArrow(fired, f"{keys}__s double")
    return made.withColumnsRenamed(dict(zip(names, by)))


def anomalies(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts of kept rows and of their flags: out of order, dropouts, derived altitudes."""
    flag = lambda bit: F.count_if(F.col("flags").bitwiseAND(bit) != 0)
    return df.groupBy(*by).agg(F.count("*").alias("kept"), flag(1).alias("inverted"), flag(2).alias("dropouts"), flag(4).alias("from_pressure"))


def placed(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """`df` with `place`, from 1, in the order of its group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def lag_s(detected: str = "detected_s", peak: str = "peak_s") -> Column:
    """Seconds from the peak to its detection."""
    return F.col(detected) - F.col(peak)


def first_above(df: DataFrame, by: list[str], order: list[str], value: str, level: float, columns: list[str]) -> DataFrame:
    """The columns of each series' first row whose value has reached a level."""
    return df.where(F.col(value) >= level).groupBy(*by).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__r")).select(*by, "__r.*")


def summary(states: DataFrame, by: list[str]) -> DataFrame:
    """Per trajectory (s, lat, lon, alt_m, phase, wind_extrapolated): apogee, duration,
    burst and landing where there are some, states with wind held, and states."""
    at = lambda phase, c: F.max(F.when(F.col("phase") == phase, F.col(c)))
    return states.groupBy(*by).agg(F.max("alt_m").alias("apogee_m"), F.max("s").alias("duration_s"), at("BURST", "alt_m").alias("burst_alt_m"), at("BURST", "s").alias("burst_s"), at("LANDED", "lat").alias("landing_lat"), at("LANDED", "lon").alias("landing_lon"), F.count_if("wind_extrapolated").alias("wind_held"), F.count("*").alias("states"))
