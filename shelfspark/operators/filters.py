"""Row filters and column projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.expr import clip_col, flag, safe_divide, with_scalars
from shelfspark.functions.stats import quantile_row, ranked_values
from shelfspark.session import written

# Id columns tried in order, code-like product patterns, months of each season.
ID_COLUMNS = ["product_id", "product_name", "product", "sku", "item_id", "item_name"]
CODE_PATTERNS = [r"^P\d+$", r"^PROD\d+$", r"^[A-Z]{1,3}\d+$"]
SEASONS = {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8), "Fall": (9, 10, 11)}
FLAGS = ["promotion", "holiday_flag", "disaster_flag", "availability"]


def filter_product(df: DataFrame, value: str, store: str | None = None) -> DataFrame:
    out = df.filter(F.col("product_name").cast("string") == value)
    if store is not None and "store" in df.columns:
        out = out.filter(F.col("store").cast("string") == store)
    return out


def filter_any_id(df: DataFrame, value: str) -> DataFrame:
    """Rows where any id column that is present equals the value."""
    tests = [F.col(c).cast("string") == value for c in ID_COLUMNS if c in df.columns]
    return df.filter(reduce(lambda a, b: a | b, tests)) if tests else df.limit(0)


def filter_contains_ci(df: DataFrame, col: str, text: str) -> DataFrame:
    return df.filter(F.lower(F.col(col).cast("string")).contains(text.lower()))


def filter_code_regex(df: DataFrame, col: str) -> DataFrame:
    """Drop values that look like codes; when every value does, keep all rows."""
    upper = F.upper(F.col(col).cast("string"))
    is_code = reduce(lambda a, b: a | b, [upper.rlike(p) for p in CODE_PATTERNS])
    any_name = df.agg(F.coalesce(F.bool_or(~is_code), F.lit(False)).alias("x")).scalar()
    return df.filter(~is_code | ~any_name)


def filter_valid_prices(panel: DataFrame) -> DataFrame:
    return panel.dropna(subset=["sales_qty", "price", "product_name"]).filter("sales_qty > 0 AND price > 0")


def filter_isin(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.filter(F.col(col).isin(values))


def project_numeric(df: DataFrame) -> DataFrame:
    """Numeric columns only, infinities to null, columns without any value dropped."""
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    inf = F.lit(float("inf"))
    clean = df.select(*[F.when(F.abs(F.col(c).cast("double")) != inf, F.col(c)).alias(c) for c in nums])
    counts = clean.agg(*[F.count(c).alias(c) for c in nums]).first()  # one row, one number per column
    return clean.select(*[c for c in nums if counts[c] > 0])


def revenue(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue", F.col("price") * F.col("sales_qty"))


def ratio(df: DataFrame, a: str, b: str, out: str, default: float = 0.0) -> DataFrame:
    return df.withColumn(out, safe_divide(a, b, default))


def stock_ratios(df: DataFrame) -> DataFrame:
    qty, stock = F.col("sales_qty"), F.col("stock_on_hand")
    return df.withColumns(
        {
            "stock_sales_ratio": stock / (qty + 1),
            "sales_stock_ratio": qty / (stock + 1),
            "days_of_stock": stock / (qty + 1),
        }
    )


def stock_flags(df: DataFrame, lo: float = 0.5, hi: float = 2.0) -> DataFrame:
    """Low and high stock against the median of the whole column."""
    wide = with_scalars(df, quantile_row(df, {"stock_median": ("stock_on_hand", 0.5)}))
    return wide.withColumns(
        {
            "low_stock": flag(F.col("stock_on_hand") < F.col("stock_median") * lo),
            "high_stock": flag(F.col("stock_on_hand") > F.col("stock_median") * hi),
        }
    )


def season_flags(df: DataFrame, date: str = "week_start") -> DataFrame:
    month, quarter = F.month(date), F.quarter(date)
    return df.withColumns(
        {
            "is_year_end": flag(month.isin(11, 12)),
            "is_year_start": flag(month.isin(1, 2)),
            "is_mid_year": flag(month.isin(6, 7)),
            **{f"is_q{q}": flag(quarter == q) for q in (1, 2, 3, 4)},
            "is_weekend": flag(F.weekday(date) >= 5),
        }
    )


def season_from_month(df: DataFrame, date: str = "week_start") -> DataFrame:
    if "season" in df.columns:
        return df
    season = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        season = F.when(F.month(date).isin(*months), name).otherwise(season)
    return df.withColumn("season", season)


def binary_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in FLAGS if c in df.columns})


def interactions(df: DataFrame) -> DataFrame:
    season = F.col("season_encoded") if "season_encoded" in df.columns else F.lit(0)
    return df.withColumns(
        {
            "price_promotion_interaction": F.col("price") * F.col("promotion"),
            "holiday_season_interaction": F.col("holiday_flag") * season,
            "stock_availability_interaction": F.col("stock_on_hand") * F.col("availability"),
            "price_stock_interaction": F.col("price") * F.col("stock_on_hand"),
        }
    )


def one_hot(df: DataFrame, values: dict[str, list]) -> DataFrame:
    """One 0/1 column per listed value of every listed column. Other values and nulls are 0 in all of them.

    The caller names the values, since they become columns; `label_encode` takes columns with any number.
    """
    out = df
    for c, listed in values.items():
        out = out.withColumns({f"{c}_{v}": flag(F.coalesce(F.col(c) == v, F.lit(False))) for v in listed})
    return out.drop(*values)


def clip(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    return df.withColumn(col, clip_col(col, lo, hi))


def format_report(df: DataFrame) -> DataFrame:
    """Currency, percent and message text of a price change per row (price, new_price)."""
    change = F.try_divide(F.col("new_price") - F.col("price"), F.col("price")) * 100
    return df.withColumns(
        {
            "price_text": F.concat(F.lit("$"), F.format_number("price", 2)),
            "change_text": F.format_string("%+.1f%%", change),
            "share_text": F.format_string("%.0f%%", F.col("share") * 100),
            "message": F.concat(F.col("urgency"), F.lit(" - "), F.col("product_name"), F.lit(" has "),
                                F.format_string("%.1f", F.col("weeks")), F.lit(" weeks of stock left")),
        }
    )


BROADCAST = 32 << 20  # bytes of values and codes up to which the codes of a column are broadcast


def encode(df: DataFrame, labels: list[str], frequencies: list[str]) -> DataFrame:
    """Label codes and row counts of category columns, attached from one pass over the values."""
    cols = sorted({*labels, *frequencies})
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols}
    table = written(ranked_values(df.select(*[t.alias(c) for c, t in texts.items()]), cols), "codes")
    rows = {r["name"]: r["n"] for r in table.groupBy("name").agg(F.sum(F.octet_length("value") + 48).alias("n")).collect()}  # one row per column
    out = df
    for c in cols:
        new = [F.col("code").alias(f"{c}_encoded")] if c in labels else []
        new += [F.col("n").alias(f"{c}_frequency")] if c in frequencies else []
        side = table.filter(F.col("name") == c).select(F.col("value").alias("__v"), *new)
        out = out.join(F.broadcast(side) if rows.get(c, 0) <= BROADCAST else side, texts[c] == F.col("__v"), "left").drop("__v")
    return out


def label_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Position of each value in sorted distinct order; nulls are encoded as the text 'nan'."""
    return encode(df, cols, [])


def frequency_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows per value on every row: counts are pre-aggregated, so a hot value is one row."""
    return encode(df, [], cols)
