"""Rows of a stream in order of time: each waits in state until the watermark has passed it.

A processor built on `InOrder` sees a group's rows one at a time, in the order
that a batch over the whole log would have, however they arrive within the
watermark's delay.  Rows that come behind the watermark, or without a time, are
handed out as rejects and touch nothing else.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows that wait in one entry of state.
TOGETHER = 10_000
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Holds a group's rows (us, id and the columns of `row`) until the watermark is
    past them, then calls `step` for each, by time, id and arrival.

    A subclass names the columns of its rows (`row`), of its own state (`own`) and
    of what it gives (`out`), and says what state it begins with (`begin`), what a
    row does (`step`) and, if it asks to be called `idle_us` after its last row,
    what is due then (`idle`).  Both give the next state and a list of tuples.
    One timer a group is set, at the earliest time that matters.
    """

    row = "s double"
    own = "n long"
    out = "s double"
    idle_us: int | None = None

    def begin(self) -> tuple:
        raise NotImplementedError

    def step(self, key: tuple, state: tuple, us: int, row: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def idle(self, key: tuple, state: tuple) -> tuple[tuple, list[tuple]]:
        return state, []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one entry holds the rows of a call as lists, in order of arrival
        self.waiting = handle.getListState("waiting", ", ".join(f"{c.rsplit(' ', 1)[0]} array<{c.rsplit(' ', 1)[1]}>" for c in ("us long", "id long", *self.row.split(", "))))
        self.kept = handle.getValueState("kept", f"timer_ms long, last_us long, first_us long, {self.own}")
        self.width = len(self.row.split(","))
        self.names = [c.split()[0] for c in self.out.split(", ")]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed, late, fresh = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        timer, last, first, *state = self.kept.get() or (-1, -1, -1, *self.begin())
        for us, id_, *row in (r[-2 - self.width :] for r in rows):
            if us is None or us < passed:
                late.append((True, us, id_, row[0]))
                continue
            fresh.append((us, -(2**62) if id_ is None else id_, *row))
            if len(fresh) == TOGETHER:
                first = self._put_by(fresh, first)
                fresh = []
        if late:
            yield from self._rows(key, late)
        if fresh:
            first = self._put_by(fresh, first)
        yield from self._release(key, passed, timer, last, first, state)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, last, first, *state = self.kept.get()
        yield from self._release(key, timerValues.getCurrentWatermarkInMs() * 1000, -1, last, first, state)

    def _put_by(self, rows: list[tuple], first: int) -> int:
        """Adds rows to those that wait; the earliest time among them all."""
        self.waiting.appendValue(tuple(map(list, zip(*rows, strict=True))))
        own = min(r[0] for r in rows)
        return own if first < 0 else min(first, own)

    def _release(self, key: tuple, passed: int, timer: int, last: int, first: int, state: list) -> Iterator[Row]:
        """Steps over all that the watermark has passed and sets the timer for what has to wait."""
        own, made = tuple(state), []
        if 0 <= first < passed:
            # equal times and ids stay in order of arrival
            at = sorted((r for some in self.waiting.get() for r in zip(*some, strict=True)), key=lambda r: r[:2])
            cut = bisect_left(at, passed, key=lambda r: r[0])
            for us, id_, *row in at[:cut]:
                own, found = self.step(key, own, us, tuple(row))
                made += [(False, us, id_, None, *x) for x in found]
                last = us
            if rest := at[cut:]:
                first = rest[0][0]
                self.waiting.put([tuple(map(list, zip(*rest[k : k + TOGETHER], strict=True))) for k in range(0, len(rest), TOGETHER)])
            else:
                first = -1
                self.waiting.clear()
        due = last + self.idle_us if self.idle_us is not None and last >= 0 else None
        if due is not None and due < passed and first < 0:
            own, found = self.idle(key, own)
            made += [(False, last, None, None, *x) for x in found]
            last, due = -1, None
        wanted = min([t for t in (first, due) if t is not None and t >= 0], default=None)
        wanted = -1 if wanted is None else wanted // 1000 + 1
        if wanted != timer:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if wanted >= 0:
                self.handle.registerTimer(wanted)
        self.kept.update((wanted, last, first, *own))
        yield from self._rows(key, made)

    def _rows(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        made = Row(*[f"_key{i}" for i in range(len(key))], "late", "us", "id", "late_s", *self.names)
        for r in rows:
            yield made(*key, *r, *[None] * (4 + len(self.names) - len(r)))

    def close(self) -> None:
        pass


def processed(stream: DataFrame, by: list[str], at: str, id_col: str, row: dict[str, Column], processor: InOrder, delay: str) -> DataFrame:
    """`stream` through `processor`, group by group, in order of the timestamp `at`
    and then `id_col`; rows over `delay` behind the latest time seen are rejects.

    Gives the columns of `by`, late (a reject), us (the row's time in microseconds),
    id, late_s (a reject's first column) and what the processor gives.  The first
    column of `row` is a number; its names are the processor's.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    # a plain number keeps late rows: Spark drops those whose column carries the watermark
    timed = stream.withWatermark(at, delay).select(*by, F.unix_micros(F.col(at)).alias("us"), F.col(id_col).cast("long").alias("id"), *[c.alias(n) for n, c in row.items()])
    schema = ", ".join([f"_key{i} {kinds[c]}" for i, c in enumerate(by)] + ["late boolean, us long, id long, late_s double", processor.out])
    made = timed.groupBy(*by).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return made.withColumnsRenamed({f"_key{i}": c for i, c in enumerate(by)})


def run(made: DataFrame, path: str) -> DataFrame:
    """Runs a stream until its source has no more, writing to `path` (a folder that
    all executors share); what it wrote.  A run that is begun again goes on from its checkpoint."""
    spark: SparkSession = made.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    try:
        query = made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(made.schema).parquet(f"{path}/out")
