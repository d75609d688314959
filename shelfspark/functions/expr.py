"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEY = "product_name"
TIME = "week_start"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by(key=KEY) -> WindowSpec:
    """All rows of one product. At most one row per week, so a group is bounded by the calendar."""
    return Window.partitionBy(*([key] if isinstance(key, str) else key))


def ordered(key=KEY, order=TIME) -> WindowSpec:
    return by(key).orderBy(order)


def rows(lo: int, hi: int, key=KEY, order=TIME) -> WindowSpec:
    return ordered(key, order).rowsBetween(lo, hi)


def up_to_now(key=KEY, order=TIME) -> WindowSpec:
    return ordered(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def from_now(key=KEY, order=TIME) -> WindowSpec:
    """The row and all later ones, newest first.

    Written as a growing frame in reverse order, which costs one step per row; a frame
    that ends at UNBOUNDED FOLLOWING is evaluated anew for every row. The value nearest to
    the row is therefore the frame's last one.
    """
    return by(key).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def newest_first(key=KEY, order=TIME) -> WindowSpec:
    return by(key).orderBy(F.col(order).desc())


def safe_divide(a, b, default: float = 0.0) -> Column:
    """a / b, or `default` when b is 0 or either side is null."""
    return F.coalesce(F.try_divide(col(a), col(b)), F.lit(default))


def clip_col(c, lo=None, hi=None) -> Column:
    out = col(c)
    if lo is not None:
        out = F.when(out.isNotNull(), F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo)))
    if hi is not None:
        out = F.when(out.isNotNull(), F.least(out, hi if isinstance(hi, Column) else F.lit(hi)))
    return out


def pct(new, old) -> Column:
    """Percent change from old to new; null when old is 0."""
    return F.try_divide(col(new) - col(old), col(old)) * 100


def places(c, k: int) -> Column:
    """Half up to k places in plain double arithmetic, for values below 10^(15 - k)."""
    return F.floor(col(c) * F.lit(10.0**k) + F.lit(0.5)) / F.lit(10.0**k)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where a lambda would compute it for every mention."""
    return F.transform(F.array(value), body)[0]


def trunc(c) -> Column:
    """Drop the fraction, towards zero."""
    return col(c).cast("bigint")


def flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery, evaluated once per query."""
    return df.select(F.struct(*df.columns)).scalar()


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame to every row without a join."""
    row = "__row"
    out = df.withColumn(row, one_row(stats))
    return out.select(*df.columns, *[F.col(f"{row}.{c}").alias(c) for c in stats.columns])


def values_table(spark, names: list[str], rows_: list[tuple]) -> DataFrame:
    """A small literal table (scenarios, weights)."""
    return spark.createDataFrame(rows_, names)


def each(df: DataFrame, names: list[str], rows_: list[tuple]) -> DataFrame:
    """Every row of df once per literal row: an explode of a constant array, no join."""
    items = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows_])
    return df.withColumn("__x", F.explode(items)).select(
        *df.columns, *[F.col(f"__x.{n}").alias(n) for n in names]
    )


def stacked(df: DataFrame, name: str, value: str, pairs: list[tuple[str, Column]], keep=()) -> DataFrame:
    """Columns to long form: one output row per (label, expression)."""
    items = F.array(*[F.struct(F.lit(n).alias("n"), c.alias("v")) for n, c in pairs])
    return df.select(*keep, F.explode(items).alias("__x")).select(
        *keep, F.col("__x.n").alias(name), F.col("__x.v").alias(value)
    )
