"""Laplace noise for released user counts (sensitivity 1); event counts stay exact.

``noisy_users`` draws from a keyed hash of the cell, so asking again never averages the noise away.
``sample_laplace`` draws from Spark's generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENSITIVITY = 1.0
EPSILON = 1.0


def laplace(u: Column, scale: float) -> Column:
    """Laplace variate of a uniform one in [-0.5, 0.5); the end of the range is held away from infinity."""
    return F.lit(-scale) * F.signum(u) * F.log(F.greatest(F.lit(1.0) - F.lit(2.0) * F.abs(u), F.lit(2.0**-53)))


def sample_laplace(scale: float, seed: int | None = None) -> Column:
    return laplace((F.rand(seed) if seed is not None else F.rand()) - 0.5, scale)


def hashed_uniform(seed: str, *key: Column) -> Column:
    """Uniform in [-0.5, 0.5) from 52 bits of a hash of seed and key."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("long").cast("double") / float(2**52) - 0.5


def noisy_count(value: Column, noise: Column) -> Column:
    """Rounded, never negative."""
    return F.round(F.greatest(F.lit(0.0), value.cast("double") + noise)).cast("long")


def noisy_users(cells: DataFrame, key: list[str], seed: str, epsilon: float = EPSILON, enabled: bool = True) -> DataFrame:
    """Released cells with noise on ``users``."""
    if not enabled:
        return cells
    if not epsilon > 0:
        raise ValueError("epsilon must be positive")
    noise = laplace(hashed_uniform(seed, *[F.col(k) for k in key]), SENSITIVITY / epsilon)
    return cells.withColumn("users", noisy_count(F.col("users"), noise))
