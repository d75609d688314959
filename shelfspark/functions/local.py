"""Local regression by moments that rows add to the positions near them.

A row is exploded once per distance and adds its weighted moments to the position that far away; positions are groups
below the series' key, so a series that is partitioned by its key is smoothed without another shuffle and no
group is ever held as an array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[Column], Column]


def tricube(half: Column) -> Kernel:
    """Weights that fall to 0 one position beyond `half`."""

    def weight(d: Column) -> Column:
        u = d / (half + 1.0)
        rest = 1.0 - u * u * u
        return F.when(u < 1, rest * rest * rest).otherwise(0.0)

    return weight


def one_period(period: Column) -> Kernel:
    """Weights of a centred mean over `period` positions: half at both ends where it is even."""
    return lambda d: F.when(2 * d < period, 1.0).when(2 * d == period, 0.5).otherwise(0.0)


def near_moments(df: DataFrame, keys: list[str], at: str, value: Column, weight: Column, kernel: Kernel, reach: int) -> DataFrame:
    """df with the sums s0, s1, s2 (of weights by powers of the distance) and t0, t1 (of values so) over the rows around each.

    (keys, at) is unique, `at` a whole number; `kernel` gives the weight of a distance up to `reach`, which may depend on columns
    that are constant per key, and `weight` a row's own. Rows without a value add nothing. The other columns of df hold numbers or dates.
    """
    kept = [c for c in df.columns if c not in (*keys, at)]
    w = kernel(F.abs("__d").cast("double")) * weight
    far = df.withColumns({"__v": value, "__d": F.explode(F.sequence(F.lit(-reach), F.lit(reach)))})
    far = far.withColumn("__w", F.when(F.col("__v").isNotNull(), w).otherwise(0.0)).where((F.col("__w") > 0) | (F.col("__d") == 0))
    # the row stands at -d as seen from the position it adds to
    d, v, own = -F.col("__d"), F.coalesce("__v", F.lit(0.0)), F.col("__d") == 0
    moved = far.withColumn(at, F.col(at) + F.col("__d"))
    sums = {"s0": F.col("__w"), "s1": F.col("__w") * d, "s2": F.col("__w") * d * d, "t0": F.col("__w") * v, "t1": F.col("__w") * d * v}
    out = moved.groupBy(*keys, at).agg(
        *[F.sum(c).alias(name) for name, c in sums.items()], *[F.max(F.when(own, F.col(c))).alias(c) for c in kept], F.max(own).alias("__own")
    )
    return out.where("__own").drop("__own")


def line_at() -> Column:
    """Value at distance 0 of the weighted line of `near_moments`, or the weighted mean where its rows have one position only."""
    s0, s1, s2, t0, t1 = (F.col(c) for c in ("s0", "s1", "s2", "t0", "t1"))
    det = s0 * s2 - s1 * s1
    return F.when(det > 1e-9 * s0 * s2, (s2 * t0 - s1 * t1) / det).when(s0 > 0, t0 / s0)


def bisquare(residual: Column, scale: Column, least: float) -> Column:
    """Weight of a residual: 1 at 0, `least` at the scale, from there on falling by the square; 1 where the scale is nothing but rounding."""
    u = F.abs(residual) / scale
    rest = 1.0 - u * u
    return F.when(scale > 1e-9, F.when(u < 1, F.greatest(rest * rest, F.lit(least))).otherwise(least / (u * u))).otherwise(1.0)
