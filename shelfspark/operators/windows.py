"""Ordered per-product features. Every window of a block shares one partitioning on the product."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY, TIME, by, flag, newest_first, ordered, rows, with_scalars
from shelfspark.functions.stats import fill_median, quantile_row, sized_join
from shelfspark.operators.cleaning import carried, carried_back
from shelfspark.operators.filters import encode, interactions, season_from_month
from shelfspark.session import written

EPS = 1e-6


def full(agg, c: str, k: int, key=KEY, order=TIME) -> Column:
    """Aggregate over the last k rows, null until there are k values."""
    w = rows(-(k - 1), 0, key, order)
    return F.when(F.count(c).over(w) == k, agg(c).over(w))


def partial(agg, c: str, k: int, key=KEY, order=TIME) -> Column:
    return agg(c).over(rows(-(k - 1), 0, key, order))


def lag_columns(lags=(1, 2, 4, 8)) -> dict[str, Column]:
    return {f"sales_qty_lag_{k}": F.lag("sales_qty", k).over(ordered()) for k in lags}


def lag_features(df: DataFrame, lags=(1, 2, 4, 8)) -> DataFrame:
    """Lagged quantity; the first rows take the median of the whole lag column."""
    exprs = lag_columns(lags)
    return fill_median(written(df.withColumns(exprs), "lags"), list(exprs))


def lag_features_weekly(df: DataFrame, lags=(1, 2, 3, 7), order: str = TIME) -> DataFrame:
    """Lagged quantity; the first rows take the trailing 4-row mean that includes the row."""
    mean4 = partial(F.avg, "sales_qty", 4, order=order)
    return df.withColumns(
        {f"lag_{k}": F.coalesce(F.lag("sales_qty", k).over(ordered(KEY, order)), mean4) for k in lags}
    )


def strict_columns(widths=(3, 6, 12)) -> dict[str, Column]:
    return {
        f"sales_qty_{n}_{k}": full(f, "sales_qty", k)
        for k in widths
        for n, f in (("ma", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    }


def rolling_strict(df: DataFrame, widths=(3, 6, 12)) -> DataFrame:
    """Rolling figures that need a full window; the rest takes the median of the whole column."""
    exprs = strict_columns(widths)
    return fill_median(written(df.withColumns(exprs), "rolling"), list(exprs))


def rolling_partial(df: DataFrame, widths=(4, 8, 12, 26), extremes: bool = False, order: str = TIME) -> DataFrame:
    out = {}
    for k in widths:
        out[f"rolling_mean_{k}"] = partial(F.avg, "sales_qty", k, order=order)
        out[f"rolling_std_{k}"] = F.coalesce(partial(F.stddev_samp, "sales_qty", k, order=order), F.lit(0.0))
        if extremes:
            out[f"rolling_min_{k}"] = partial(F.min, "sales_qty", k, order=order)
            out[f"rolling_max_{k}"] = partial(F.max, "sales_qty", k, order=order)
    return df.withColumns(out)


def rolling_centered(df: DataFrame, width: int, value: str = "sales_qty", out: str = "centered") -> DataFrame:
    """Centred full-window mean, its ends filled from the nearest complete window."""
    w = rows(-(width // 2), (width - 1) // 2)
    mean = F.when(F.count(value).over(w) == width, F.avg(value).over(w))
    df = df.withColumn(out, mean)
    return df.withColumn(out, F.coalesce(carried(out), carried_back(out)))


def rolling_pair_smooth(fc: DataFrame, order: str = "date") -> DataFrame:
    """Centred 3-row mean of the forecast, partial at the ends."""
    return fc.withColumn("yhat", F.avg("yhat").over(rows(-1, 1, KEY, order)))


def change(c: str, key=KEY, order=TIME) -> Column:
    prev = F.lag(c).over(ordered(key, order))
    return F.try_divide(F.col(c), prev) - 1


def pct_change(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(f"{col}_pct_change", change(col))


def diff(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(f"{col}_diff", F.col(col) - F.lag(col).over(ordered()))


def price_columns() -> dict[str, Column]:
    return {
        "price_change": change("price"),
        "price_lag_1": F.lag("price").over(ordered()),
        "price_volatility_3": full(F.stddev_samp, "price", 3),
        "price_volatility_6": full(F.stddev_samp, "price", 6),
        "price_relative_to_avg": F.try_divide(F.col("price"), F.avg("price").over(by())),
    }


def with_category_price(df: DataFrame) -> DataFrame:
    """Price against its category mean: the mean is aggregated per category, never windowed."""
    means = df.groupBy("category").agg(F.avg("price").alias("__cp"))
    out = sized_join(df, means, "category")
    return out.withColumn("price_relative_to_category", F.try_divide(F.col("price"), F.col("__cp"))).drop("__cp")


def price_features(df: DataFrame) -> DataFrame:
    exprs = price_columns()
    wide = written(with_category_price(df).withColumns(exprs), "price")
    return fill_median(wide, [*exprs, "price_relative_to_category"])


def inventory_columns() -> dict[str, Column]:
    stock, qty = F.col("stock_on_hand"), F.col("sales_qty")
    return {
        "stock_sales_ratio": stock / (qty + 1),
        "sales_stock_ratio": qty / (stock + 1),
        "avg_stock_4w": full(F.avg, "stock_on_hand", 4),
        "stock_change": stock - F.lag("stock_on_hand").over(ordered()),
    }


def with_stock_level(df: DataFrame, source: DataFrame) -> DataFrame:
    wide = with_scalars(df, quantile_row(source, {"__sm": ("stock_on_hand", 0.5)}))
    return wide.withColumns(
        {
            "low_stock": flag(F.col("stock_on_hand") < F.col("__sm") * 0.5),
            "high_stock": flag(F.col("stock_on_hand") > F.col("__sm") * 2),
        }
    ).drop("__sm")


def inventory_features(df: DataFrame) -> DataFrame:
    exprs = inventory_columns()
    return fill_median(written(with_stock_level(df.withColumns(exprs), df), "stock"), list(exprs))


def volatility_ratios(df: DataFrame, order: str = TIME) -> DataFrame:
    m = {k: partial(F.avg, "sales_qty", k, order=order) for k in (3, 6, 12)}
    std = F.coalesce(partial(F.stddev_samp, "sales_qty", 3, order=order), F.lit(0.0))
    return df.withColumns(
        {
            "ratio_3_6": m[3] / (m[6] + EPS),
            "ratio_6_12": m[6] / (m[12] + EPS),
            "volatility": std / (m[3] + EPS),
        }
    )


def weeks_from_start(df: DataFrame, date: str = TIME) -> DataFrame:
    first = df.agg(F.min(date).alias("__first")).scalar()
    return df.withColumn("weeks_from_start", F.floor(F.datediff(F.col(date), first) / 7))


def latest_row(df: DataFrame) -> DataFrame:
    """Newest row per product, reduced on the map side."""
    rest = [c for c in df.columns if c not in (KEY, TIME)]
    last = df.groupBy(KEY).agg(F.max(F.struct(TIME, *rest)).alias("r"))
    return last.select(KEY, "r.*")


def last_n_mean(df: DataFrame, n: int = 4, value: str = "sales_qty") -> DataFrame:
    ranked = df.withColumn("__rn", F.row_number().over(newest_first())).filter(F.col("__rn") <= n)
    return ranked.groupBy(KEY).agg(F.avg(value).alias(f"mean_last_{n}"))


def half_trend(df: DataFrame) -> DataFrame:
    """(mean of the newer half - mean of the older half) / older; 0 with fewer than 4 rows."""
    n = F.count(F.lit(1)).over(by())
    halves = df.withColumns({"__rn": F.row_number().over(ordered()), "__n": n})
    old = F.col("__rn") <= F.floor(F.col("__n") / 2)
    out = halves.groupBy(KEY).agg(
        F.avg(F.when(old, F.col("sales_qty"))).alias("first_half"),
        F.avg(F.when(~old, F.col("sales_qty"))).alias("second_half"),
        F.count(F.lit(1)).alias("n"),
    )
    trend = (F.col("second_half") - F.col("first_half")) / (F.col("first_half") + EPS)
    return out.withColumn("half_trend", F.when(F.col("n") >= 4, trend).otherwise(0.0))


def zscore_product(df: DataFrame, col: str) -> DataFrame:
    z = (F.col(col) - F.avg(col).over(by())) / (F.stddev_samp(col).over(by()) + EPS)
    return df.withColumn("z_score", z)


def cyclic(name: str, value: Column, period: int) -> dict[str, Column]:
    angle = 2 * math.pi * value / period
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def time_features(df: DataFrame, date: str = TIME) -> DataFrame:
    """Calendar columns; a missing date gives 0."""
    zero = F.lit(0)
    parts = {
        "year": F.year(date), "month": F.month(date), "quarter": F.quarter(date),
        "week_of_year": F.weekofyear(date), "day_of_year": F.dayofyear(date),
    }
    out = df.withColumns({n: F.coalesce(c, zero) for n, c in parts.items()})
    out = out.withColumns({**cyclic("month", F.col("month"), 12), **cyclic("quarter", F.col("quarter"), 4)})
    out = out.withColumns(
        {
            "is_year_end": flag(F.col("month").isin(11, 12)),
            "is_year_start": flag(F.col("month").isin(1, 2)),
            "is_mid_year": flag(F.col("month").isin(6, 7)),
        }
    )
    out = weeks_from_start(out, date)
    return out.withColumn("weeks_from_start", F.coalesce("weeks_from_start", F.lit(0)))


def weekly_features(df: DataFrame, order: str = TIME) -> DataFrame:
    """Inputs of the boosted forecast: lags, rolling figures, calendar and its cycles."""
    out = rolling_partial(lag_features_weekly(df, order=order), order=order)
    out = out.withColumns(
        {
            "month": F.month(order), "quarter": F.quarter(order), "year": F.year(order),
            "weekofyear": F.weekofyear(order),
        }
    )
    return out.withColumns({**cyclic("month", F.col("month"), 12), **cyclic("week", F.col("weekofyear"), 52)})


def rich_features(df: DataFrame, price: bool = True, order: str = TIME) -> DataFrame:
    """The wide single-series feature set with its gaps filled."""
    out = df.withColumns(
        {
            "year": F.year(order), "month": F.month(order), "week": F.weekofyear(order), "day": F.day(order),
            "dayofweek": F.weekday(order), "is_weekend": flag(F.weekday(order) >= 5),
            "quarter": F.quarter(order), "dayofyear": F.dayofyear(order),
        }
    )
    out = rolling_partial(out, (3, 6, 12, 26), extremes=True, order=order)
    lags = [f"lag_{k}" for k in (1, 2, 4, 8)]
    out = out.withColumns({f"lag_{k}": F.lag("sales_qty", k).over(ordered(KEY, order)) for k in (1, 2, 4, 8)})
    out = out.withColumns({f"is_q{q}": flag(F.col("quarter") == q) for q in (1, 2, 3, 4)})
    if price:
        out = out.withColumns(
            {
                "sales_per_price": F.col("sales_qty") / (F.col("price") + EPS),
                "pct_change_sales": F.coalesce(change("sales_qty", order=order), F.lit(0.0)) * 100,
                "pct_change_price": F.coalesce(change("price", order=order), F.lit(0.0)) * 100,
            }
        )
        moved = F.col("pct_change_price") + EPS
        out = out.withColumn("price_elasticity", F.try_divide(F.col("pct_change_sales"), moved))
    out = volatility_ratios(out, order)
    out = out.withColumns({**cyclic("month", F.col("month"), 12), **cyclic("week", F.col("week"), 52)})
    for c in lags:  # only the lags can have gaps: linear by row inside, nearest value at the ends
        out = out.withColumn(c, F.coalesce(F.col(c), carried_back(c, KEY, order), carried(c, KEY, order), F.lit(0.0)))
    return out


def feature_table(df: DataFrame) -> DataFrame:
    """All 51 model features in one table.

    Category codes, counts and means are small tables attached to the rows first; one
    shuffle on the product then feeds every window. The result is written once, so that
    finding all medians is a column scan and not a second run of the windows.
    """
    base = encode(season_from_month(df), ["category", "product_name", "season", "weather"], ["category", "product_name"])
    base = time_features(with_category_price(base))
    windowed = {**lag_columns(), **strict_columns(), **price_columns(), **inventory_columns()}
    wide = written(interactions(base.withColumns(windowed)), "features")
    filled = [*windowed, "price_relative_to_category"]
    medians = quantile_row(wide, {f"__m_{c}": (c, 0.5) for c in [*filled, "stock_on_hand"]})
    out = with_scalars(wide, medians)
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in filled})
    stock, mid = F.col("stock_on_hand"), F.col("__m_stock_on_hand")
    out = out.withColumns({"low_stock": flag(stock < mid * 0.5), "high_stock": flag(stock > mid * 2)})
    return out.drop(*medians.columns)


def split_chronological(df: DataFrame, f: float = 0.8, key=KEY, order: str = TIME) -> DataFrame:
    """First floor(f n) rows of each product train, the rest test."""
    n = F.count(F.lit(1)).over(by(key))
    rn = F.row_number().over(ordered(key, order))
    return df.withColumn("split", F.when(rn <= F.floor(F.lit(f) * n), "train").otherwise("test"))


def tail_per_group(df: DataFrame, n: int = 2, key=KEY, order: str = TIME) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return df.withColumn("__rn", rn).filter(F.col("__rn") <= n).drop("__rn")


