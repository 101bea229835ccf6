"""The burst detector over a stream, with state per flight."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ordered import InOrder, processed

ROWS, RISE, FALL, TIMES = 9, 1.0, -2.0, 3
_OUT = "flight string, detected_s double, peak_s double, peak double"
_STATE = "s array<double>, alt array<double>, risen boolean, run int, fired boolean"
#: The state before the first sample; a detector begins anew from it.
BEGIN = ([], [], False, 0, False)


def check_settings(rows: int, rise: float, fall: float, times: int) -> None:
    """Raises for settings under which no burst, or any wobble, would be found."""
    if rows < 3:
        raise ValueError("a slope needs three samples")
    if times < 1:
        raise ValueError("a burst needs a confirmation")
    if not fall < 0 < rise:
        raise ValueError("a fall is under zero and a rise over it")


def slope_of(s: list[float], alts: list[float]) -> float:
    """Least-squares slope of altitudes; 0 where time does not vary.

    Means and moments are carried from sample to sample as `regr_slope` does it, so
    that a slope at a threshold is rounded to the side that `series.detect_burst` sees."""
    mean_s = mean_alt = both = spread = 0.0
    for n, (x, y) in enumerate(zip(s, alts, strict=True), 1):
        ds = x - mean_s
        step = ds / n
        mean_s += step
        mean_alt += (y - mean_alt) / n
        both += ds * (y - mean_alt)
        spread += ds * (ds - step)
    return both / spread if spread else 0.0


def current_rate(state: tuple) -> float | None:
    """The rate a detector in this state sees; after the burst the last one before it
    was confirmed stays.  None before it has enough samples."""
    return slope_of(state[0], state[1]) if len(state[0]) == ROWS else None


def advance(state: tuple, at: float | None, alt: float | None) -> tuple[tuple, tuple | None]:
    """The detector's next state after a sample, and (detected_s, peak_s, peak) if it
    confirms a burst.  Samples without time or altitude change nothing."""
    s, alts, risen, run, fired = state
    if fired or at is None or alt is None or math.isnan(at) or math.isnan(alt):
        return state, None
    s, alts = [*s, float(at)][-ROWS:], [*alts, float(alt)][-ROWS:]
    if len(s) < ROWS:
        return (s, alts, risen, run, fired), None
    slope = slope_of(s, alts)
    risen = bool(risen or slope > RISE)
    run = run + 1 if risen and slope < FALL else 0
    if run < TIMES:
        return (s, alts, risen, run, fired), None
    top = alts.index(max(alts))
    return (s, alts, risen, run, True), (float(at), s[top], alts[top])


def _step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = (list(state.get[0]), list(state.get[1]), *state.get[2:]) if state.exists else BEGIN
    found = []
    for row in pd.concat(list(frames)).sort_values("s").itertuples():
        now, event = advance(now, row.s, row.alt_m)
        if event:
            found.append((key[0], *event))
    state.update(now)
    yield pd.DataFrame(found, columns=["flight", "detected_s", "peak_s", "peak"])


def detect(stream: DataFrame) -> DataFrame:
    """(flight, s, alt_m) to one row per flight, when its burst is detected.

    Samples of a batch are put in order of time; later batches are taken as they
    come, and rows without time or altitude are passed over.  `detect_ordered` is
    for streams whose batches overlap in time.
    """
    return stream.groupBy("flight").applyInPandasWithState(_step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


class _Burst(InOrder):
    row, own, out = "s double, alt_m double", _STATE, "detected_s double, peak_s double, peak double"

    def begin(self) -> tuple:
        return BEGIN

    def step(self, key: tuple, state: tuple, us: int, row: tuple) -> tuple[tuple, list[tuple]]:
        after, event = advance((list(state[0]), list(state[1]), *state[2:]), *row)
        return after, [event] if event else []


def detect_ordered(stream: DataFrame, by: list[str], at: str, id_col: str, s: str, alt_m: str, delay: str = "10 seconds") -> DataFrame:
    """A stream of bursts and of rejects (late); `bursts` and `rejects` tell them apart.

    Whatever the order of arrival, within the watermark's delay, the bursts are
    those of `series.detect_burst` over the whole log, ordered by the timestamp
    `at`, then `id_col`.  Rows behind the watermark or without a time are rejects.
    """
    return processed(stream, by, at, id_col, {"s": F.col(s).cast("double"), "alt_m": F.col(alt_m).cast("double")}, _Burst(), delay)


def bursts(made: DataFrame, by: list[str]) -> DataFrame:
    return made.where("not late").select(*by, "detected_s", "peak_s", "peak")


def rejects(made: DataFrame, by: list[str]) -> DataFrame:
    return made.where("late").select(*by, "us", "id", F.col("late_s").alias("s"))
