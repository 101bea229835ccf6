"""Unit conversion and quantity strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CELSIUS_ZERO_K, LENGTH_M, MASS_KG, PRESSURE_PA

_NUMBER = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)\s*([A-Za-z]*)\s*$"


def to_si(value: Column, unit: Column, factors: dict[str, float]) -> Column:
    """`value` of `unit` in the SI unit; null for a unit that is not known."""
    known = sorted(factors)
    out = F.when(unit == known[0], value * factors[known[0]])
    for u in known[1:]:
        out = out.when(unit == u, value * factors[u])
    return out


def length_m(value: Column, unit: Column) -> Column:
    return to_si(value, unit, LENGTH_M)


def mass_kg(value: Column, unit: Column) -> Column:
    return to_si(value, unit, MASS_KG)


def pressure_pa(value: Column, unit: Column) -> Column:
    return to_si(value, unit, PRESSURE_PA)


def temperature_k(value: Column, unit: Column) -> Column:
    return F.when(unit == "K", value).when(unit == "C", value + CELSIUS_ZERO_K).when(unit == "F", (value - 32) * 5 / 9 + CELSIUS_ZERO_K)


def parse_quantity(text: Column, factors: dict[str, float], si: str) -> Column:
    """A number with an optional unit ("1200 ft") in SI; null if either is not understood."""
    number = F.regexp_extract(text, _NUMBER, 1).try_cast("double")
    unit = F.regexp_extract(text, _NUMBER, 2)
    return to_si(number, F.when(unit == "", si).otherwise(unit), factors)
