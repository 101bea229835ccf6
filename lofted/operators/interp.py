"""Interpolating lookups in sorted nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import cut_points, range_of

#: Nodes that are sent with the plan, as a tree of comparisons.
SENT_NODES = 512


def lookup(df: DataFrame, at: Column, nodes: DataFrame, x: str, ys: list[str], by: list[str] | None = None) -> DataFrame:
    """`df` with each y of sorted nodes interpolated at `at`, held outside them, and
    `extrapolated` for strictly outside.

    Up to SENT_NODES nodes of one group are read and sent with the plan, so rows
    stay where they are.  Else each distinct place meets the nodes next to it in one sorted range of places
    and nodes; a range without one takes that of the ranges before or after, so
    neither side is broadcast and no range holds all.  Null places give nulls;
    nodes without x are left out, and of equal x only one may stand in a group.
    """
    by = by or []
    if not by:
        few = nodes.select(F.col(x).cast("double").alias("x"), *[F.col(y).cast("double").alias(y) for y in ys]).where("x is not null").limit(SENT_NODES + 1).collect()
        if len(few) <= SENT_NODES:
            return _sent(df, at, sorted(few, key=lambda r: r.x), ys)
    keys = [f"__by{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys)]
    own = nodes.select(*named, F.col(x).cast("double").alias("__x"), F.struct(F.col(x).cast("double").alias("x"), *ys).alias("__node")).where("__x is not null")
    cuts = cut_points(own, "__x")
    left = df.withColumn("__place", at.cast("double"))
    places = left.select(*named, F.col("__place").alias("__x")).where("__x is not null").distinct()
    both = own.withColumn("__kind", F.lit(0)).unionByName(places.withColumn("__kind", F.lit(1)), allowMissingColumns=True).withColumn("__range", range_of(F.col("__x"), cuts))
    w = Window.partitionBy(*keys, "__range")
    near = both.withColumn("__low", F.last("__node", True).over(w.orderBy("__x", "__kind").rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("__high", F.last("__node", True).over(w.orderBy(F.desc("__x"), F.desc("__kind")).rowsBetween(Window.unboundedPreceding, 0))).where("__kind = 1")
    # the last node before each range and the first after it; a group has a row for each of its ranges
    ends = both.groupBy(*keys, "__range").agg(F.max_by("__node", F.when(F.col("__kind") == 0, F.col("__x"))).alias("__last"), F.min_by("__node", F.when(F.col("__kind") == 0, F.col("__x"))).alias("__first"))
    run = Window.partitionBy(*keys)
    ends = ends.withColumn("__before", F.last("__last", True).over(run.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("__after", F.last("__first", True).over(run.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.select(*[F.col(k).alias(k + "e") for k in keys], F.col("__range").alias("__rangee"), "__before", "__after")
    on = F.col("__range") == F.col("__rangee")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(k + "e"))
    low, high = F.coalesce("__low", "__before"), F.coalesce("__high", "__after")
    found = near.join(ends, on).select(*keys, "__x", low.alias("__low"), high.alias("__high"))
    share = (F.col("__x") - F.col("__low.x")) / (F.col("__high.x") - F.col("__low.x"))
    value = lambda y: F.coalesce(F.col(f"__low.{y}") + share * (F.col(f"__high.{y}") - F.col(f"__low.{y}")), F.col(f"__low.{y}"), F.col(f"__high.{y}"))
    outside = F.col("__low").isNull() | (F.col("__high").isNull() & (F.col("__x") != F.col("__low.x")))
    made = found.where("__low is not null or __high is not null").select(*keys, F.col("__x").alias("__at"), *[value(y).alias(f"__y{i}") for i, y in enumerate(ys)], outside.alias("__out"))
    on = F.col("__place") == F.col("__at")
    for c, k in zip(by, keys):
        on = on & F.col(c).eqNullSafe(F.col(k))
    return left.join(made, on, "left").select(*df.columns, *[F.col(f"__y{i}").alias(y) for i, y in enumerate(ys)], F.col("__out").alias("extrapolated"))


def _sent(df: DataFrame, at: Column, nodes: list, ys: list[str]) -> DataFrame:
    """`lookup` in nodes that the plan holds: a place's rank among them picks the two beside it."""
    if not nodes:
        return df.select("*", *[F.lit(None).cast("double").alias(y) for y in ys], F.lit(None).cast("boolean").alias("extrapolated"))
    number = lambda v: "cast(null as double)" if v is None else f"double('{v!r}')"
    held = {c: F.expr(f"array({', '.join(number(r[c]) for r in nodes)})") for c in ("x", *ys)}  # one text, not a call for each node
    own = df.withColumn("__place", at.cast("double")).withColumn("__rank", range_of(F.col("__place"), [r.x for r in nodes]))
    own = own.withColumns({f"__{side}_{i}": F.get(held[c], F.col("__rank") - back) for i, c in enumerate(("x", *ys)) for side, back in (("low", 1), ("high", 0))})
    share = (F.col("__place") - F.col("__low_0")) / (F.col("__high_0") - F.col("__low_0"))
    known = F.col("__place").isNotNull()
    between = lambda i: F.coalesce(F.col(f"__low_{i}") + share * (F.col(f"__high_{i}") - F.col(f"__low_{i}")), F.col(f"__low_{i}"), F.col(f"__high_{i}"))
    out = [F.when(known, between(i)).alias(y) for i, y in enumerate(ys, 1)]
    outside = F.col("__low_0").isNull() | (F.col("__high_0").isNull() & (F.col("__place") != F.col("__low_0")))
    return own.select(*df.columns, *out, F.when(known, outside).alias("extrapolated"))


def nearest(df: DataFrame, by: list[str], at: Column, target: Column, value: str) -> DataFrame:
    """`value` of the row nearest to a target, the first of equal ones."""
    return df.groupBy(*by).agg(F.min_by(value, F.struct(F.abs(at - target), at)).alias(value))
