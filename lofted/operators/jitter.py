"""Jitter of weighted samples in place: shrinkage to the mean, correlated noise, redraws.

Moments and their roots are one row a group; noise is a hash of the seed and of
what tells a sample apart, so neither depends on how rows are partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gauss import truncated
from . import sample, weights


def root(df: DataFrame, names: list[str], floors: dict[str, float] | None = None, out: str = "root") -> DataFrame:
    """`df` with the lower triangular root (`out`_a_b, a not before b) of the covariances
    cov_a_b that `weights.moments` gives, to whose variances the squares of `floors`
    are added.

    A dimension without variance left gets zeros, so that it is not moved, where
    Cholesky's method would fail.  Each entry is a column of its own, made from
    those before it, so expressions stay short.
    """
    cov = lambda a, b: F.col(f"cov_{a}_{b}") if names.index(a) <= names.index(b) else F.col(f"cov_{b}_{a}")
    entry = lambda a, b: F.col(f"{out}_{a}_{b}")
    for j, b in enumerate(names):
        done = names[:j]
        rest = cov(b, b) + (floors or {}).get(b, 0.0) ** 2 - sum((entry(b, k) * entry(b, k) for k in done), F.lit(0.0))
        df = df.withColumn(f"{out}_{b}_{b}", F.when(rest > 0, F.sqrt(rest)).otherwise(0.0))
        below = {a: cov(a, b) - sum((entry(a, k) * entry(b, k) for k in done), F.lit(0.0)) for a in names[j + 1 :]}
        df = df.withColumns({f"{out}_{a}_{b}": F.when(entry(b, b) > 0, x / entry(b, b)).otherwise(0.0) for a, x in below.items()})
    return df


def shrinkage(discount: float) -> tuple[float, float]:
    """Share that a sample keeps of itself, and what the noise is scaled by, so that
    the mean and variance of the set stay as they are (Liu and West)."""
    if not 1 / 3 < discount <= 1:
        raise ValueError("the discount must be over 1/3 and not over 1")
    a = (3 * discount - 1) / (2 * discount)
    return a, math.sqrt(1 - a * a)


def liu_west(df: DataFrame, by: list[str], order: list[str], names: list[str], seed: int, weight: str = "w", discount: float = 0.98, u: float = 0.5, floors: dict[str, float] | None = None, bounds: dict[str, tuple[float, float]] | None = None, noise: dict[str, Column] | None = None, copy: str = "copy") -> DataFrame:
    """Resamples each group to its own size and jitters `names`: rows of `df` with
    `copy`, each drawn towards the group's weighted mean and moved by noise that has
    its covariance, then held in `bounds`.

    `order` tells a group's rows apart; with `copy` it is what the noise hangs on,
    unless `noise` gives each name's unit normals.  Null keys are a group of their own.
    """
    a, kernel = shrinkage(discount)
    renamed = {c: f"__by{i}" for i, c in enumerate(by)}
    stats = weights.moments(df.select(*[F.col(c).alias(n) for c, n in renamed.items()], weight, *names), list(renamed.values()), names, weight)
    stats = root(stats, names, floors, "__root")
    picked = weights.resample(df, by, order, weight, u, copy)
    same = F.lit(True)
    for c, n in renamed.items():
        same = same & picked[c].eqNullSafe(stats[n])
    both = picked.join(stats, same)
    noise = noise or {n: sample.normal(seed, F.lit(n), *[F.col(c) for c in (*by, *order, copy)]) for n in names}
    both = both.withColumns({f"__z_{n}": z for n, z in noise.items()})

    def moved(k: int, name: str) -> Column:
        x = a * F.col(name) + (1 - a) * F.col(f"mean_{name}") + kernel * sum((F.col(f"__root_{name}_{b}") * F.col(f"__z_{b}") for b in names[: k + 1]), F.lit(0.0))
        low, high = (bounds or {}).get(name, (-math.inf, math.inf))
        return F.greatest(F.lit(low), F.least(F.lit(high), x))

    return both.select(*[moved(names.index(c), c).alias(c) if c in names else F.col(c) for c in df.columns], copy)


def redraw(df: DataFrame, name: str, mean: float, sd: float, low: float, high: float, reached: Column, censored: Column, seed: int, keys: list[str]) -> DataFrame:
    """`df` with `name` drawn from a cut normal: beyond `reached` where `censored` (it has
    got so far without the event, so the threshold lies beyond), else from all of it."""
    u = sample.uniform(seed, F.lit(name), *[F.col(c) for c in keys])
    return df.withColumn(name, truncated(u, mean, sd, low, high, F.when(censored, reached)))
