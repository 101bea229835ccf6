"""When to predict a flight's landing anew, over a stream of its updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.replay import LANDED_M
from .ordered import InOrder, processed


class _Due(InOrder):
    """State: when it last fired, and the updates of the latest time, which may be the last."""

    row, out = "s double, alt_m double, burst boolean", "fired_s double"
    own = "fired double, s array<double>, alt array<double>, burst array<boolean>, us long"

    def __init__(self, gap_s: float, ground_m: float, idle_s: float):
        self.gap_s, self.floor_m, self.idle_us = gap_s, ground_m + LANDED_M, int(idle_s * 1_000_000)

    def begin(self) -> tuple:
        return None, [], [], [], -1

    def _decide(self, fired: float | None, held: list[tuple], last: bool) -> tuple[float | None, list[tuple]]:
        """Which of the updates of one time fire, forced ones first."""
        out = []
        for s, alt, burst in sorted(held, key=lambda r: not (last or r[2])):
            if s is None or alt is None or not alt > self.floor_m:
                continue
            if fired is None or s - fired >= self.gap_s or ((burst or last) and s != fired):
                fired = s
                out.append((s,))
        return fired, out

    def step(self, key: tuple, state: tuple, us: int, row: tuple) -> tuple[tuple, list[tuple]]:
        fired, *held, at = state
        made = []
        if at >= 0 and us != at:
            fired, made = self._decide(fired, list(zip(*held, strict=True)), False)
            held = [[], [], []]
        s, alt, burst = ([*old, new] for old, new in zip(held, (row[0], row[1], bool(row[2])), strict=True))
        return (fired, s, alt, burst, us), made

    def idle(self, key: tuple, state: tuple) -> tuple[tuple, list[tuple]]:
        fired, *held, _ = state
        fired, made = self._decide(fired, list(zip(*held, strict=True)), True)
        return (fired, [], [], [], -1), made


def due_updates(stream: DataFrame, by: list[str], at: str, id_col: str, s: str, alt_m: str, burst: str, gap_s: float, ground_m: float, idle_s: float, delay: str = "10 seconds") -> DataFrame:
    """`replay.due_updates` of a stream: by, late, us and fired_s, a row for each update
    that fires and for each reject (late).

    An update is decided when the next one of its flight is known not to be
    earlier.  The last one, which always fires if it is in the air, is known by
    silence: no update for `idle_s` of event time.  A flight that speaks again
    after that goes on with what it last fired.
    """
    row = {"s": F.col(s).cast("double"), "alt_m": F.col(alt_m).cast("double"), "burst": F.coalesce(F.col(burst), F.lit(False))}
    return processed(stream, by, at, id_col, row, _Due(gap_s, ground_m, idle_s), delay)


def fired(made: DataFrame, by: list[str]) -> DataFrame:
    return made.where("not late").select(*by, "fired_s")
