"""Type coercion, imputation, resampling, capping and smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.expr import (
    KEY, TIME, by, clip_col, from_now, ordered, rows, up_to_now, with_scalars,
)
from shelfspark.functions.stats import fill_median, mode_of

# Accepted date layouts, month before day and day before month.
MONTH_FIRST = ["yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy"]
DAY_FIRST = ["yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy"]


def _parsed(col: str, layouts: list[str]) -> Column:
    return F.coalesce(*[F.try_to_date(F.trim(col), f) for f in layouts])


def coerce_date(df: DataFrame, col: str, formats: int = 2) -> DataFrame:
    """Parse month-first; when more than half of the column fails and `formats` is 2, day-first."""
    first = _parsed(col, MONTH_FIRST)
    if formats < 2:
        return df.withColumn(col, first)
    failed = df.agg(F.avg(F.when(first.isNull(), 1.0).otherwise(0.0)).alias("x")).scalar()
    return df.withColumn("__f", failed).withColumn(
        col, F.when(F.col("__f") > 0.5, _parsed(col, DAY_FIRST)).otherwise(first)
    ).drop("__f")


def _number(col: str) -> Column:
    n = F.col(col).try_cast("double")
    return F.when(~F.isnan(n), n)


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numbers from text, bad and missing values to 0."""
    return df.withColumns({c: F.coalesce(_number(c), F.lit(0.0)) for c in cols})


def coerce_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """How many values of each column had to be replaced."""
    return df.agg(*[F.count_if(_number(c).isNull()).alias(f"bad_{c}") for c in cols])


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def impute_mean_mode(df: DataFrame) -> DataFrame:
    nums = _numeric(df)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    wide = with_scalars(df, df.agg(*[F.avg(c).alias(f"__m_{c}") for c in nums]))
    wide = wide.withColumns({f"__m_{c}": mode_of(df, c) for c in texts})
    fill = set(nums + texts)
    return wide.select(
        *[F.coalesce(F.col(c), F.col(f"__m_{c}")).alias(c) if c in fill else F.col(c) for c in df.columns]
    )


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    return fill_median(df, cols)


def preprocess_dates_median(df: DataFrame) -> DataFrame:
    """Text columns named like dates become dates, then numeric nulls become the column median."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    dates = [c for c in df.columns if c in texts and ("date" in c.lower() or "week" in c.lower())]
    out = df.withColumns({c: _parsed(c, MONTH_FIRST) for c in dates}) if dates else df
    return fill_median(out, _numeric(out))


def carried(c: str, key=KEY, order=TIME) -> Column:
    return F.last(c, ignorenulls=True).over(up_to_now(key, order))


def carried_back(c: str, key=KEY, order=TIME) -> Column:
    return F.last(c, ignorenulls=True).over(from_now(key, order))


def ffill_bfill(df: DataFrame, key, cols: list[str], order: str = TIME) -> DataFrame:
    """Last value forward, then first value backward, then 0."""
    return df.withColumns(
        {c: F.coalesce(carried(c, key, order), carried_back(c, key, order), F.lit(0.0)) for c in cols}
    )


def fill_context(df: DataFrame, order: str = TIME) -> DataFrame:
    """Price: carry forward, then the product's median; stock: carry forward, then 0; flags: 0."""
    exprs = {
        "price": F.coalesce(carried("price", KEY, order), F.percentile("price", F.lit(0.5)).over(by())),
        "stock_on_hand": F.coalesce(carried("stock_on_hand", KEY, order), F.lit(0.0)),
    }
    exprs.update({c: F.coalesce(F.col(c), F.lit(0)) for c in ("promotion", "holiday_flag") if c in df.columns})
    return df.withColumns(exprs)


def dedupe_keep_last(df: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """One row per key, the last by the tie columns. A hot key is reduced on the map side."""
    rest = [c for c in df.columns if c not in keys and c not in tie]
    last = df.groupBy(*keys).agg(F.max(F.struct(*tie, *rest)).alias("__r"))
    return last.select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def spine_daily(df: DataFrame, key: str = KEY, date: str = "date") -> DataFrame:
    """Every day between a product's first and last date, with its values where there are any."""
    span = df.groupBy(key).agg(F.min(date).alias("__a"), F.max(date).alias("__b"))
    days = span.select(key, F.explode(F.sequence("__a", "__b", F.expr("interval 1 day"))).alias(date))
    return days.join(df, [key, date], "left")


def week_ending_sunday(date) -> Column:
    return F.next_day(F.date_sub(date, 1), "SUN")


def resample_weekly(df: DataFrame, key: str = KEY, value: str = "sales_qty", date: str = "date") -> DataFrame:
    """Sum per week ending Sunday; a week without rows is 0, and so is a null value."""
    weekly = df.groupBy(key, week_ending_sunday(date).alias("week")).agg(F.sum(value).alias("__s"))
    span = weekly.groupBy(key).agg(F.min("week").alias("__a"), F.max("week").alias("__b"))
    weeks = span.select(key, F.explode(F.sequence("__a", "__b", F.expr("interval 7 days"))).alias("week"))
    out = weeks.join(weekly, [key, "week"], "left")
    return out.select(key, F.col("week").alias(date), F.coalesce("__s", F.lit(0.0)).alias(value))


def zero_policy(df: DataFrame, share: float = 0.5, key: str = KEY, value: str = "sales_qty", date: str = "date") -> DataFrame:
    """Negatives to 0. Mostly-zero products carry neighbours over their zeros; elsewhere zeros become null."""
    v = F.greatest(F.col(value), F.lit(0.0))
    zeros = F.avg(F.when(v == 0, 1.0).otherwise(0.0)).over(by(key))
    out = df.withColumn("__sparse", zeros > share).withColumn(value, F.when(v != 0, v))
    fill = F.coalesce(carried(value, key, date), carried_back(value, key, date))
    return out.withColumn(value, F.when(F.col("__sparse"), fill).otherwise(F.col(value))).drop("__sparse")


def interpolate_linear(
    df: DataFrame, key=KEY, value: str = "sales_qty", order: str = TIME, limit: int | None = 8, both: bool = False
) -> DataFrame:
    """Linear in time between known neighbours, at most `limit` steps after the last known one.

    Rows after the last known value repeat it (same limit); with `both`, rows before the
    first known value take it.
    """
    w, back, ahead = ordered(key, order), up_to_now(key, order), from_now(key, order)
    known = F.col(value).isNotNull()
    n = df.withColumn("__rn", F.row_number().over(w))
    n = n.withColumns(
        {
            "__pv": F.last(value, ignorenulls=True).over(back),
            "__pt": F.last(F.when(known, F.col(order)), ignorenulls=True).over(back),
            "__pn": F.last(F.when(known, F.col("__rn")), ignorenulls=True).over(back),
            "__nv": F.last(value, ignorenulls=True).over(ahead),
            "__nt": F.last(F.when(known, F.col(order)), ignorenulls=True).over(ahead),
        }
    )
    share = F.try_divide(F.datediff(order, "__pt").cast("double"), F.datediff("__nt", "__pt"))
    line = F.col("__pv") + (F.col("__nv") - F.col("__pv")) * share
    near = F.lit(True) if limit is None else F.col("__rn") - F.col("__pn") <= limit
    filled = F.when(known, F.col(value)).when(
        F.col("__pv").isNotNull() & near, F.when(F.col("__nv").isNull(), F.col("__pv")).otherwise(line)
    )
    if both:
        filled = F.when(F.col("__pv").isNull(), F.col("__nv")).otherwise(filled)
    return n.withColumn(value, filled).drop("__rn", "__pv", "__pt", "__pn", "__nv", "__nt")


def cap_iqr(df: DataFrame, key: str = KEY, k: float = 2.0, value: str = "sales_qty") -> DataFrame:
    """Clip to [max(0, Q1 - k IQR), Q3 + k IQR] of the product."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).over(by(key))
    out = df.withColumn("__q", q)
    lo, hi = F.col("__q")[0], F.col("__q")[1]
    low, high = F.greatest(F.lit(0.0), lo - k * (hi - lo)), hi + k * (hi - lo)
    return out.withColumn(value, clip_col(value, low, high)).drop("__q")


def cap_3sigma(df: DataFrame, key: str = KEY, value: str = "sales_qty") -> DataFrame:
    """Clip above mean + 3 sample standard deviations, where the deviation is positive."""
    out = df.withColumns({"__m": F.avg(value).over(by(key)), "__s": F.stddev_samp(value).over(by(key))})
    capped = F.least(F.col(value), F.col("__m") + 3 * F.col("__s"))
    return out.withColumn(value, F.when(F.col("__s") > 0, capped).otherwise(F.col(value))).drop("__m", "__s")


def smooth_blend(
    df: DataFrame, key: str = KEY, width: int = 7, share: float = 0.8, value: str = "sales_qty", date: str = TIME
) -> DataFrame:
    """share * centred mean (partial at the ends) + (1 - share) * value."""
    mean = F.avg(value).over(rows(-(width // 2), (width - 1) // 2, key, date))
    return df.withColumn(value, share * mean + (1 - share) * F.col(value))


def preprocess_series(df: DataFrame) -> DataFrame:
    """Cap outliers, fill the calendar, carry sales, smooth, fill the context columns."""
    out = spine_daily(cap_iqr(df))
    out = smooth_blend(ffill_bfill(out, KEY, ["sales_qty"], "date"), date="date")
    return fill_context(out, "date")


def preprocess_weekly(df: DataFrame, tie: list[str], min_weeks: int = 8) -> DataFrame:
    """Deduplicated, zero-handled, weekly, capped series of the products with enough weeks.

    `tie` names the columns that order the records of one date: the last of them is kept.
    """
    return _weekly(df, tie).filter(F.col("weeks") >= min_weeks).drop("weeks")


def weekly_rejects(df: DataFrame, tie: list[str], min_weeks: int = 8) -> DataFrame:
    """Products left out of `preprocess_weekly` and their week counts."""
    short = _weekly(df, tie).groupBy(KEY).agg(F.count(F.lit(1)).alias("weeks"))
    return short.filter(F.col("weeks") < min_weeks)


def _weekly(df: DataFrame, tie: list[str]) -> DataFrame:
    rows_ = df.select(KEY, "date", "sales_qty", *[c for c in tie if c not in (KEY, "date", "sales_qty")])
    rows_ = dedupe_keep_last(rows_, [KEY, "date"], tie)
    weekly = resample_weekly(zero_policy(rows_))
    return cap_3sigma(weekly).withColumn("weeks", F.count(F.lit(1)).over(by()))


