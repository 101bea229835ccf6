"""Running totals and lookups over whole tables.

Values are cut into ranges of about equal rows; each range is totalled for
itself, and only the totals of ranges run through one task per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a column is cut into.
PARTS = 128
#: Rows from which a table, or a series, is dealt to several tasks by ranges.
LONG = 1_000_000


def matched(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """`left` joined to `right` on `by`, null matching null; the columns of `by` are left's."""
    names = {c: f"__of_{c}" for c in by}
    on = F.lit(True)
    for c, n in names.items():
        on = on & F.col(c).eqNullSafe(F.col(n))
    return left.join(right.withColumnsRenamed(names), on, how).drop(*names.values())


def cut_points(df: DataFrame, column: str, parts: int = PARTS) -> list:
    """Fewer than `parts` values, in order, that cut a column into about equal rows."""
    if parts < 2:
        return []
    (made,) = df.agg(F.percentile_approx(column, [k / parts for k in range(1, parts)], 10 * parts)).first()
    return sorted({v for v in made or [] if v is not None})


def cut_tuples(df: DataFrame, order: list[str], parts: int = PARTS) -> list[tuple]:
    """Cut points of the first column of `order`; a value that fills more than one range
    is cut by the second column, where that is a number or a time."""
    if parts < 2:
        return []
    (made,) = df.agg(F.percentile_approx(order[0], [k / parts for k in range(1, parts)], 10 * parts)).first()
    found = [v for v in made or [] if v is not None]
    heavy = {v: found.count(v) for v in found if found.count(v) > 1}
    kinds = dict(df.dtypes)
    if len(order) < 2 or not heavy or not (kinds[order[1]] in ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz") or kinds[order[1]].startswith("decimal")):
        return sorted({(v,) for v in found})
    shares = [k / parts for k in range(1, parts)]
    inner = df.where(F.col(order[0]).isin(list(heavy))).groupBy(order[0]).agg(F.percentile_approx(order[1], shares, 10 * parts)).collect()  # a row for each heavy value, fewer than `parts`
    cuts = {(v,) for v in found}
    for v, points in inner:
        step = max(1, parts // (heavy[v] + 1))
        cuts |= {(v, w) for w in points[step - 1 :: step] if w is not None}
    return sorted(cuts)


def range_of_tuple(columns: list[Column], cuts: list[tuple]) -> Column:
    """`range_of` for cuts of one or two columns; (v,) lies before all (v, w)."""

    def under(cut: tuple) -> Column:
        first = columns[0] < F.lit(cut[0])
        return first if len(cut) == 1 else first | ((columns[0] == F.lit(cut[0])) & F.coalesce(columns[1] < F.lit(cut[1]), F.lit(True)))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(under(cuts[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(cuts))


def range_of(x: Column, cuts: list) -> Column:
    """How many of the sorted cuts are not above x, by a tree of comparisons; null is beyond all."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x < F.lit(cuts[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(cuts))


def running(df: DataFrame, by: list[str], order: list[str], values: dict[str, Column], parts: int = PARTS) -> DataFrame:
    """`df` with, for each name in `values`, the sum of that value over the rows of
    the group up to this one (name), before it (name_before) and in all
    (name_total).  `order` tells the rows of a group apart; its first column is a
    number or a time; rows that share its value are cut by the second.  With `parts`
    of 1 a group is one range."""
    names, cuts = list(values), cut_tuples(df, order, parts)
    cut = df.withColumn("__range", range_of_tuple([F.col(c) for c in order[:2]], cuts))
    w = Window.partitionBy(*by, "__range").orderBy(*order)
    summed = cut.select("*", *[F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__own_{k}") for k, v in values.items()])
    own = summed.select("*", *[F.coalesce(F.lag(f"__own_{k}").over(w), F.lit(0)).alias(f"__ago_{k}") for k in names])
    ends = summed.groupBy(*by, "__range").agg(F.max(F.struct(*order, *[f"__own_{k}" for k in names])).alias("__end"))
    run = Window.partitionBy(*[f"__by{i}" for i in range(len(by))])
    base = ends.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__range").alias("__at"), *[F.col(f"__end.__own_{k}").alias(f"__t_{k}") for k in names])
    before = run.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("*", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__base_{k}") for k in names], *[F.sum(f"__t_{k}").over(run).alias(f"{k}_total") for k in names])
    on = F.col("__range") == F.col("__at")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    out = [x for k in names for x in ((F.col(f"__base_{k}") + F.col(f"__own_{k}")).alias(k), (F.col(f"__base_{k}") + F.col(f"__ago_{k}")).alias(f"{k}_before"), F.col(f"{k}_total"))]
    return own.join(base, on).select(*df.columns, *out)


def previous(df: DataFrame, by: list[str], number: str, value: str, size: int, out: str) -> DataFrame:
    """`df` with the value of the row before, in order of the whole number `number`, which
    tells a group's rows apart.

    Blocks of `size` numbers look back for themselves; then only the first and last
    rows of blocks meet, so a group of any length is many tasks."""
    own = df.withColumn("__block", F.floor(F.col(number) / size))
    w = Window.partitionBy(*by, "__block").orderBy(number)
    inside = own.withColumns({out: F.lag(value).over(w), "__first": F.row_number().over(w) == 1, "__edge": F.lead(F.lit(1)).over(w).isNull() | (F.row_number().over(w) == 1)})
    edges = Window.partitionBy(*by, F.when(F.col("__edge"), -1).otherwise(F.col("__block"))).orderBy(number)
    met = inside.withColumn("__last", F.lag(value).over(edges))
    return met.withColumn(out, F.when(F.col("__first"), F.col("__last")).otherwise(F.col(out))).drop("__block", "__first", "__edge", "__last")
