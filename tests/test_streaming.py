import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lofted.operators import series
from lofted.plans import queries, queries_series, replay
from lofted.streaming import burst, due, ordered

KIND = "flight string, id long, s double, alt_m double, burst boolean, at timestamp"
START = dt.datetime(2026, 9, 14, 4, 30)


def at(s):
    return None if s is None else START + dt.timedelta(seconds=s)


def fed(spark, tmp_path, batches):
    """A stream of one batch for each list of (flight, id, s, alt_m, burst)."""
    for k, rows in enumerate(batches):
        spark.createDataFrame([(*r, at(r[2])) for r in rows], KIND).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))


def flight(name, rng, top=200, n=250):
    alt = np.concatenate([np.arange(top) * 5.0, top * 5.0 - 20 * np.arange(float(n - top))]) + rng.standard_normal(n)
    return [(name, i, float(i), float(v), False) for i, v in enumerate(alt)]


def test_detector_keeps_state_between_batches(spark, tmp_path):
    rng = np.random.default_rng(3)
    alt = np.concatenate([np.arange(0, 1000, 5.0), 1000 - 20 * np.arange(50.0)]) + rng.standard_normal(250)
    rows = [("a", float(i), float(v)) for i, v in enumerate(alt)] + [("b", float(i), 5.0 * i) for i in range(250)]
    kind = "flight string, s double, alt_m double"
    for k, part in enumerate(([r for r in rows if r[1] < 203], [r for r in rows if r[1] >= 203])):
        spark.createDataFrame([*part, ("a", 100.5 + 100 * k, None), ("a", None, 5.0)], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = burst.detect(stream).writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    (found,) = spark.table("bursts").collect()
    assert found.flight == "a" and abs(found.peak_s - 200) <= 2 and 200 <= found.detected_s <= 212


def test_unordered_batches_give_the_rows_of_a_batch(spark, tmp_path):
    rng, shuffle = np.random.default_rng(5), random.Random(7)
    rows = [*flight("a", rng), *flight("b", rng, 120), *flight("c", rng, 250), ("a", 900, 100.5, None, False), ("b", 7, 7.0, 35.0, False)]
    last = ("z", 0, 400.0, 0.0, False)
    # arrival strays by under 30 seconds; four batches overlap in time
    arrival = sorted(rows, key=lambda r: r[2] + shuffle.uniform(0, 29))
    batches = [arrival[k::1][:0] for k in range(4)]
    for k, r in enumerate(arrival):
        batches[min(3, k * 4 // len(arrival))].append(r)
    stream = fed(spark, tmp_path, [*batches, [last]])
    made = ordered.run(burst.detect_ordered(stream, ["flight"], "at", "id", "s", "alt_m", "30 seconds"), str(tmp_path / "run"))
    whole = spark.createDataFrame([r[:4] for r in rows], "flight string, id long, s double, alt_m double")
    want = series.detect_burst(whole, ["flight"], ["s", "id"], "alt_m", "s").select("flight", "detected_s", "peak_s", "peak")
    assert sorted(map(tuple, burst.bursts(made, ["flight"]).collect())) == sorted(map(tuple, want.collect()))
    assert want.count() == 2 and burst.rejects(made, ["flight"]).count() == 0


def test_slopes_at_the_threshold_fall_to_the_side_of_the_batch(spark, tmp_path):
    # a height that turns at row n / 2, with what event_id % 3 adds chosen so that one slope is -2 but for rounding
    rng, rows, event = random.Random(1), [], 0
    for user in range(60):
        n = 2 * rng.randint(6, 40)
        for r in range(1, n + 1):
            added = 2 if -3 <= r - n // 2 <= 0 else 0 if 2 <= r - n // 2 <= 5 else rng.randrange(3)
            event += 1 + (added - event - 1) % 3
            rows.append((event, at(float(r)), user, 0.0))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(db.execute(queries.ORACLE_SQL["burst_detect"]).fetchall())
    assert sorted(map(tuple, queries.burst_detect(spark, str(tmp_path)).collect())) == want
    assert sorted(map(tuple, queries_series.stream_burst(spark, str(tmp_path)).collect())) == want


def test_slope_of_the_stream_is_that_of_the_batch_to_the_bit(spark):
    rng = random.Random(4)
    rows = [(k, float(s), alt) for k in range(20) for s, alt in enumerate([rng.choice((rng.uniform(-9e4, 9e4), float(rng.randrange(40)))) for _ in range(60)], 7 * k)]
    df = spark.createDataFrame(rows, "k long, s double, alt double")
    for r in series.rolling_slope(df, ["k"], ["s"], "alt", "s").where("slope is not null").collect():
        own = [x for x in rows if x[0] == r.k and r.s - 8 <= x[1] <= r.s]
        assert burst.slope_of([x[1] for x in own], [x[2] for x in own]) == r.slope
    assert burst.slope_of([3.0] * 9, [float(k) for k in range(9)]) == 0.0


def test_arrival_0_3_1_2_and_late_rows_are_rejects(spark, tmp_path):
    class Seen(ordered.InOrder):
        row, own, out = "s double", "n long", "place long, s double"

        def begin(self):
            return (0,)

        def step(self, key, state, us, row):
            return (state[0] + 1,), [(state[0] + 1, row[0])]

    batches = [[("a", k, float(k), 1.0, False)] for k in (0, 3, 1, 2)] + [[("z", 0, 60.0, 1.0, False)], [("a", 4, 4.0, 1.0, False), ("a", 5, None, 1.0, False)]]
    stream = fed(spark, tmp_path, batches)
    made = ordered.run(ordered.processed(stream, ["flight"], "at", "id", {"s": F.col("s")}, Seen(), "5 seconds"), str(tmp_path / "run"))
    assert sorted((r.place, r.s) for r in made.where("flight = 'a' and not late").collect()) == [(1, 0.0), (2, 1.0), (3, 2.0), (4, 3.0)]
    assert sorted((r.id, r.late_s) for r in made.where("late").collect()) == [(4, 4.0), (5, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_due_updates_of_a_stream_equal_those_of_the_log(spark, tmp_path, seed):
    own = random.Random(seed)
    rows = []
    for f in "abcd":
        s = 0.0
        for k in range(60):
            s += own.choice([0.0, 1.0, 7.5, 20.0])
            rows.append((f, k, s, own.choice([None, 10.0, 900.0, 1500.0, 2000.0]), own.random() < 0.05))
    rows.append(("e", 0, 5.0, 2000.0, False))
    arrival = sorted(rows, key=lambda r: r[2] + own.uniform(0, 39))
    cut = [arrival[k * 50 : k * 50 + 50] for k in range(-(-len(arrival) // 50))]
    stream = fed(spark, tmp_path, [*cut, [("z", 0, 5_000.0, 0.0, False)]])
    made = ordered.run(due.due_updates(stream, ["flight"], "at", "id", "s", "alt_m", "burst", 50.0, 100.0, 600.0, "40 seconds"), str(tmp_path / "run"))
    log = spark.createDataFrame([r[:5] for r in rows], "flight string, id long, s double, alt_m double, burst boolean")
    want = replay.due_updates(log, ["flight"], 50.0, 100.0).select("flight", "fired_s")
    assert sorted(map(tuple, due.fired(made, ["flight"]).collect())) == sorted(map(tuple, want.collect()))
    assert made.where("late").count() == 0


def test_state_is_touched_a_few_times_a_call_whatever_the_rows():
    class Kept:
        def __init__(self, calls):
            self.calls, self.held = calls, []

        def get(self):
            self.calls.append("get")
            return iter(self.held)

        def appendValue(self, value):
            self.calls.append("append")
            self.held.append(value)

        def put(self, values):
            self.calls.append("put")
            self.held = list(values)

        def clear(self):
            self.calls.append("clear")
            self.held = []

    class One(Kept):
        def get(self):
            self.calls.append("get")
            return self.held or None

        def update(self, value):
            self.calls.append("update")
            self.held = value

    class Handle:
        def __init__(self):
            self.calls = []

        def getListState(self, name, schema):
            return Kept(self.calls)

        def getValueState(self, name, schema):
            return One(self.calls)

        def registerTimer(self, at):
            self.calls.append("timer")

        def deleteTimer(self, at):
            self.calls.append("timer")

    class Passed:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    class Seen(ordered.InOrder):
        row, own, out = "s double", "n long", "place long, s double"

        def begin(self):
            return (0,)

        def step(self, key, state, us, row):
            return (state[0] + 1,), [(state[0] + 1, row[0])]

    handle, seen = Handle(), Seen()
    seen.init(handle)
    # the same time and id come in order of arrival, without an id first
    rows = [("a", us * 1_000_000, id_, float(n)) for n, (us, id_) in enumerate([(9, 1), (3, 5), (3, 5), (3, None), *[(k, k) for k in range(4, 2000)]])]
    assert list(seen.handleInputRows(("a",), iter(rows), Passed(0))) == [] and len(handle.calls) < 8
    out = list(seen.handleInputRows(("a",), iter([("a", 0, 1, 0.5)]), Passed(5000)))
    assert [(r.late, r.place, r.s, r.late_s) for r in out] == [(True, None, None, 0.5), (False, 1, 3.0, None), (False, 2, 1.0, None), (False, 3, 2.0, None), (False, 4, 4.0, None)]
    out = list(seen.handleExpiredTimer(("a",), Passed(3_000_000), None))
    assert len(out) == 1996 and out[-1].place == 2000 and len(handle.calls) < 20
