"""Weighted samples: normalisation, size, quantiles, resampling, mixtures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import LONG, PARTS, matched, running


def log_normalise(df: DataFrame, by: list[str], log_weight: str, out: str = "w") -> DataFrame:
    """Weights that sum to one from log weights; null or -inf weighs nothing, and
    where all are so, all weigh the same.  Groups are totalled, not gathered."""
    raw = F.nanvl(F.coalesce(F.col(log_weight).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    names = [f"__by{i}" for i in range(len(by))]
    tops = df.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)]).agg(F.max(raw).alias("__top"))
    same = lambda side: [F.col(c).eqNullSafe(side[n]) for c, n in zip(by, names)] or [F.lit(True)]
    x = F.when(F.col("__top") == float("-inf"), 1.0).otherwise(F.exp(raw - F.col("__top")))
    shifted = df.join(tops, _all(same(tops))).withColumn("__x", x).drop(*names, "__top")
    sums = shifted.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)]).agg(F.sum("__x").alias("__sum"))
    return shifted.join(sums, _all(same(sums))).withColumn(out, F.col("__x") / F.col("__sum")).drop(*names, "__x", "__sum")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def effective_size(weight: str = "w") -> Column:
    return 1 / F.sum(F.col(weight) * F.col(weight))


def degenerate(ess: Column, n: Column) -> Column:
    return ess < n / 10


def covers(value: Column, low: Column, high: Column) -> Column:
    """Whether a band holds a value."""
    return (value >= low) & (value <= high)


def width(low: Column, high: Column) -> Column:
    return high - low


def scatter(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per sample: n, mean, sd and the coefficient of variation."""
    own = df.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return own.withColumn("cv", F.col("sd") / F.col("mean"))


def convergence(n: str, sd: str) -> Column:
    """Slope of scatter against size, both logarithmic."""
    return F.regr_slope(F.log(F.col(sd)), F.log(F.col(n)))


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, levels: tuple[float, ...] = (0.05, 0.5, 0.95), parts: int | None = None) -> DataFrame:
    """Of each level the first value (in order) whose running share of the weight
    reaches it, else the greatest.  Equal values are one step.

    A group's steps are summed by one task, or, with `parts` over 1, by ranges of
    values side by side.  If it is not given, a table of over LONG rows is cut."""
    if parts is None:
        parts = PARTS if df.count() > LONG else 1
    steps = df.groupBy(*by, value).agg(F.sum(weight).alias("__w"))
    if parts > 1:
        run = running(steps, by, [value], {"__c": F.col("__w")}, parts).withColumn("__share", F.col("__c") / F.col("__c_total"))
    else:
        # both windows and the aggregate need the group's rows in one place, once
        steps = steps.repartition(*[F.col(c) for c in by]) if by else steps
        own = Window.partitionBy(*by)
        run = steps.withColumn("__share", F.sum("__w").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("__w").over(own))
    return run.groupBy(*by).agg(*[F.coalesce(F.min(F.when(F.col("__share") >= p, F.col(value))), F.max(value)).alias(f"q{round(p * 100):02d}") for p in levels])


def moments(df: DataFrame, by: list[str], names: list[str], weight: str = "w", floor: float = 0.0) -> DataFrame:
    """Weighted means and covariances; variances not under `floor`."""
    means = df.groupBy(*by).agg(F.sum(weight).alias("__w"), *[(F.sum(F.col(n) * F.col(weight)) / F.sum(weight)).alias(f"mean_{n}") for n in names])
    both = matched(df, means, by)
    cov = lambda a, b: F.sum(F.col(weight) * (F.col(a) - F.col(f"mean_{a}")) * (F.col(b) - F.col(f"mean_{b}"))) / F.sum(weight)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return both.groupBy(*by, *[f"mean_{n}" for n in names]).agg(*[(F.greatest(cov(a, b), F.lit(floor)) if a == b else cov(a, b)).alias(f"cov_{a}_{b}") for a, b in pairs])


def resample(df: DataFrame, by: list[str], order: list[str], weight: str = "w", u: float = 0.5, out: str = "copy") -> DataFrame:
    """Systematic resampling of each group to its own size with the draw `u`: a row
    for each copy.  Weights need not sum to one; `order` tells the rows apart and
    begins with a number.  The last row takes up what rounding leaves."""
    run = running(df, by, order, {"__c": F.col(weight), "__k": F.lit(1).cast("long")})
    n = F.col("__k_total")
    place = lambda c: F.floor(n * (F.col(c) / F.col("__c_total")) - u)
    high = F.when(F.col("__k") == n, n - 1).otherwise(F.least(n - 1, place("__c")))
    low = F.when(F.col("__k") == 1, F.lit(-1).cast("long")).otherwise(F.least(n - 1, place("__c_before")))
    counted = run.withColumn("__copies", high - low).where("__copies > 0")
    return counted.withColumn(out, F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*df.columns, out)


def pool(df: DataFrame, by: list[str], part: str, weight: str = "w") -> DataFrame:
    """A mixture of equally likely parts: weights by the number of parts of the group."""
    parts = df.groupBy(*by).agg(F.count_distinct(part).alias("__k"))
    return matched(df, parts, by).withColumn(weight, F.col(weight) / F.col("__k")).drop("__k")


def median_parameters(posterior: DataFrame, by: list[str], scaled: dict[str, tuple[str, float]], names: list[str], param: str = "param", median: str = "median") -> DataFrame:
    """One row a group with the median of each parameter of `names`; one in `scaled` is
    a scale: its median times the nominal value goes under the name given there.
    A parameter that a group does not have is null."""
    wide = posterior.groupBy(*by).pivot(param, names).agg(F.max(median))
    return wide.select(*by, *[(F.col(n) * scaled[n][1]).alias(scaled[n][0]) if n in scaled else F.col(n) for n in names])
