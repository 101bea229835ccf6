"""Roots of functions of one number, for many rows at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bisect(f: Callable[[Column], Column], low: Column, high: Column, steps: int = 64) -> Column:
    """Where f is zero between `low` and `high`, by halving the interval `steps` times in
    one fold; null where f has one sign at both ends or an end is null.  An end at
    which f is zero is the root."""
    start = F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"), F.signum(f(low)).alias("sign"))

    def half(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2
        same = F.signum(f(middle)) == state["sign"]
        return F.struct(F.when(same, middle).otherwise(state["low"]).alias("low"), F.when(same, state["high"]).otherwise(middle).alias("high"), state["sign"].alias("sign"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half, lambda state: (state["low"] + state["high"]) / 2)
    return F.when(f(low) == 0, low).when(f(high) == 0, high).when(F.signum(f(low)) != F.signum(f(high)), found)
