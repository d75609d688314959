"""Least squares per key as a mergeable aggregate, and Gram matrices of many columns.

A row's feature vector is exploded once per feature, and every exploded row adds its feature times the whole
vector: as many sums as features, combined on the map side, so a plan grows with the number of
features and not of their pairs, and no key's rows are ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, keys: list[str], x: Column, size: int) -> DataFrame:
    """(keys, i, row): row i of the sum of x x' per key, for vectors of `size` doubles without nulls."""
    vectors = df.select(*keys, x.alias("__x"))
    each = vectors.select(*keys, "__x", F.posexplode("__x").alias("i", "__v"))
    sums = each.groupBy(*keys, "i").agg(*[F.sum(F.col("__v") * F.get("__x", F.lit(j))).alias(f"__s{j}") for j in range(size)])
    return sums.select(*keys, "i", F.array(*[f"__s{j}" for j in range(size)]).alias("row"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _fold(n: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """step(acc, i) for i from 0 to n - 1."""
    return F.aggregate(F.sequence(F.lit(0), n - 1), start, step)


def cholesky(a: Column, size: int) -> Column:
    """Lower triangle L with L L' = a, as rows of growing length; `a` is symmetric and positive definite."""
    none, rows = F.array().cast("array<double>"), F.array().cast("array<array<double>>")

    def row(l: Column, i: Column) -> Column:
        def cell(r: Column, j: Column) -> Column:
            # the rows before, and the one that is made: entries up to j
            other = F.when(j == i, r).otherwise(F.get(l, j))
            left = F.get(F.get(a, i), j) - dot(r, F.slice(other, F.lit(1), j))
            return F.concat(r, F.array(F.when(j == i, F.sqrt(left)).otherwise(left / F.get(other, j))))

        return F.concat(l, F.array(_fold(i + 1, none, cell)))

    return _fold(F.lit(size), rows, row)


def substituted(l: Column, b: Column, size: int) -> Column:
    """x with L L' x = b."""
    none = F.array().cast("array<double>")
    down = _fold(F.lit(size), none, lambda z, i: F.concat(z, F.array((F.get(b, i) - dot(z, F.slice(F.get(l, i), F.lit(1), i))) / F.get(F.get(l, i), i))))

    def up(x: Column, k: Column) -> Column:
        i = F.lit(size - 1) - k
        below = F.transform(F.slice(l, i + 2, k), lambda r: F.get(r, i))
        return F.concat(F.array((F.get(down_, i) - dot(below, x)) / F.get(F.get(l, i), i)), x)

    down_ = down
    return _fold(F.lit(size), none, up)


def least_squares(df: DataFrame, keys: list[str], x: Column, y: Column, size: int, penalty: list[float]) -> DataFrame:
    """(keys, coef): coefficients per key that minimise squared errors plus `penalty` times their squares.

    `x` is an array of `size` doubles and `y` a double, both without nulls. A positive penalty on a feature keeps the
    system solvable where the feature is constant or 0.
    """
    whole = gram(df, keys, F.concat(x, F.array(y)), size + 1).where(F.col("i") < size)
    whole = whole.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "row"))).alias("rows"))  # `size` rows of a key
    ridge = F.array(*[F.lit(float(p)) for p in penalty])
    own = lambda r: F.transform(F.slice(r["row"], 1, size), lambda v, j: v + F.when(j == r["i"], F.get(ridge, j)).otherwise(F.lit(0.0)))
    solved = whole.select(*keys, F.transform("rows", own).alias("a"), F.transform("rows", lambda r: F.element_at(r["row"], size + 1)).alias("b"))
    solved = solved.withColumn("l", cholesky(F.col("a"), size))
    return solved.select(*keys, substituted(F.col("l"), F.col("b"), size).alias("coef"))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, n, corr) of every ordered pair of numeric columns, over the rows that have both, in one pass.

    Values are taken from their column's mean first, so that large offsets do not cancel digits. A pair of which one column is
    constant on those rows has null. Every row is exploded once per column and adds six sums per column.
    """
    size = len(cols)
    nums = df.select(*[F.col(c).cast("double").alias(f"v{j}") for j, c in enumerate(cols)])
    means = nums.agg(F.struct(*[F.avg(f"v{j}").alias(f"v{j}") for j in range(size)]).alias("m")).select("m").scalar()
    nums = nums.withColumn("m", means)
    away = [F.col(f"v{j}") - F.col(f"m.v{j}") for j in range(size)]
    seen = [F.when(F.col(f"v{j}").isNotNull(), 1.0).otherwise(0.0) for j in range(size)]
    wide = nums.select(F.array(*[F.coalesce(v, F.lit(0.0)) for v in away]).alias("x"), F.array(*seen).alias("k"))
    each = wide.select("x", "k", F.posexplode("x").alias("i", "v")).withColumn("o", F.get("k", F.col("i")))
    x, k = (lambda j: F.get("x", F.lit(j))), (lambda j: F.get("k", F.lit(j)))
    sums = {
        "n": lambda j: F.col("o") * k(j), "sx": lambda j: F.col("v") * k(j), "sy": lambda j: F.col("o") * x(j), "sxy": lambda j: F.col("v") * x(j),
        "sxx": lambda j: F.col("v") * F.col("v") * k(j), "syy": lambda j: F.col("o") * x(j) * x(j),
    }
    rows = each.groupBy("i").agg(*[F.sum(f(j)).alias(f"{name}{j}") for name, f in sums.items() for j in range(size)])
    cells = F.array(*[F.struct(F.lit(c).alias("b"), *[F.col(f"{name}{j}").alias(name) for name in sums]) for j, c in enumerate(cols)])
    names = F.array(*[F.lit(c) for c in cols])
    long = rows.select(F.get(names, F.col("i")).alias("a"), F.explode(cells).alias("c")).select("a", "c.*")
    spread = lambda s, q: F.col(q) - F.try_divide(F.col(s) * F.col(s), F.col("n"))
    both = F.sqrt(F.greatest(spread("sx", "sxx"), F.lit(0.0)) * F.greatest(spread("sy", "syy"), F.lit(0.0)))
    cross = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    return long.select("a", "b", F.col("n").cast("bigint").alias("n"), F.when(both > 0, cross / both).alias("corr"))
