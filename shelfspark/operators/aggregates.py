"""Grouped and whole-table aggregates, pivots and profiles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.expr import KEY, TIME, one_row, pct, safe_divide, stacked, with_scalars
from shelfspark.functions.stats import corr, quantile_row, quantiles
from shelfspark.operators.filters import season_from_month


def _revenue():
    return F.col("price") * F.col("sales_qty")


def _first(value: str, order: str = TIME):
    return F.min_by(value, order)


def product_summary(panel: DataFrame) -> DataFrame:
    """Price, quantity, revenue, promotion and stock figures per product."""
    rows = panel.withColumn("weekly_revenue", _revenue())
    stock = F.avg("stock_on_hand") if "stock_on_hand" in panel.columns else F.lit(100.0)
    out = rows.groupBy(KEY).agg(
        F.avg("price").alias("avg_price"),
        F.stddev_samp("price").alias("price_std"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.avg("sales_qty").alias("avg_sales"),
        F.sum("sales_qty").alias("total_sales"),
        F.stddev_samp("sales_qty").alias("sales_std"),
        F.avg("weekly_revenue").alias("avg_revenue"),
        F.sum("weekly_revenue").alias("total_revenue"),
        F.avg("promotion").alias("promotion_freq"),
        stock.alias("avg_stock"),
        _first("category").alias("category"),
    )
    return out.withColumn("price_variability", safe_divide("price_std", "avg_price"))


def product_series(df: DataFrame, product: str, date: str = TIME) -> DataFrame:
    """One product as a dated series; stock and price columns that are absent become null."""
    rows = df.filter(F.col(KEY).cast("string") == product).filter(F.col(date).isNotNull())
    null = F.lit(None).cast("double")
    return rows.groupBy(F.col(date).alias("date")).agg(
        F.sum("sales_qty").alias("sales_qty"),
        (F.sum("stock_on_hand") if "stock_on_hand" in df.columns else F.max(null)).alias("stock_on_hand"),
        (F.avg("price") if "price" in df.columns else F.max(null)).alias("price"),
        F.max("promotion").alias("promotion_flag"),
        F.max("holiday_flag").alias("holiday_flag"),
    )


def category_perf(panel: DataFrame, n: int = 10) -> DataFrame:
    return (
        panel.groupBy("category")
        .agg(F.sum("sales_qty").alias("total_qty"), F.avg("sales_qty").alias("mean_qty"))
        .orderBy(F.col("total_qty").desc(), "category")
        .limit(n)
    )


def flag_uplift(panel: DataFrame, flag: str) -> DataFrame:
    """Mean quantity with and without a flag and the uplift in percent (0 when the base is 0)."""
    qty = F.col("sales_qty")
    out = panel.agg(
        F.avg(F.when(F.col(flag) == 1, qty)).alias("mean_on"), F.avg(F.when(F.col(flag) == 0, qty)).alias("mean_off")
    )
    return out.withColumn("uplift_pct", F.coalesce(pct("mean_on", "mean_off"), F.lit(0.0)))


def promo_uplift(panel: DataFrame) -> DataFrame:
    return flag_uplift(panel, "promotion")


def holiday_uplift(panel: DataFrame) -> DataFrame:
    return flag_uplift(panel, "holiday_flag")


def season_perf(panel: DataFrame) -> DataFrame:
    return season_from_month(panel).groupBy("season").agg(F.avg("sales_qty").alias("mean_qty"))


def stock_overview(panel: DataFrame) -> DataFrame:
    wide = with_scalars(panel, quantile_row(panel, {"low_threshold": ("stock_on_hand", 0.1)}))
    return wide.agg(
        F.avg("stock_on_hand").alias("avg_stock"),
        F.max("low_threshold").alias("low_threshold"),
        corr("stock_on_hand", "sales_qty").alias("corr_stock_sales"),
        F.count_if(F.col("stock_on_hand") <= F.col("low_threshold")).alias("low_stock_rows"),
    )


def monthly_stock_trend(panel: DataFrame) -> DataFrame:
    """Mean stock per month and the two-month mean inside a year (null in its first month)."""
    monthly = panel.groupBy(F.year(TIME).alias("year"), F.month(TIME).alias("month")).agg(
        F.avg("stock_on_hand").alias("mean_stock")
    )
    w = Window.partitionBy("year").orderBy("month").rowsBetween(-1, 0)  # twelve rows a year
    return monthly.withColumn(
        "smoothed", F.when(F.count("mean_stock").over(w) == 2, F.avg("mean_stock").over(w))
    )


def price_sales_corr(panel: DataFrame) -> DataFrame:
    out = panel.agg(corr("price", "sales_qty").alias("corr"))
    c = F.col("corr")
    return out.withColumn(
        "relation", F.when(c < -0.2, "negative").when(c > 0.2, "positive").otherwise("weak")
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def corr_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson matrix of the numeric columns, or of the named ones, in long form, one pass over the data."""
    cols = cols or numeric_columns(df)
    pairs = list(combinations(cols, 2))
    one = df.agg(*[corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [((a, b), F.col(f"c{i}")) for i, (a, b) in enumerate(pairs)]
    cells += [((b, a), F.col(f"c{i}")) for i, (a, b) in enumerate(pairs)]
    cells += [((a, a), F.lit(1.0)) for a in cols]
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.alias("corr")) for (a, b), v in cells])
    return one.select(F.explode(items).alias("x")).select("x.a", "x.b", "x.corr")


def corr_strong_pairs(matrix: DataFrame, cut: float = 0.5) -> DataFrame:
    return (
        matrix.filter((F.col("a") < F.col("b")) & (F.abs("corr") > cut))
        .withColumn("abs_corr", F.abs("corr"))
        .orderBy(F.col("abs_corr").desc(), "a", "b")
    )


def _text_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, unique, top, freq) per text column, counted per (column, value) before any gather."""
    long = stacked(df, "name", "value", [(c, F.col(c).cast("string")) for c in cols]).where("value IS NOT NULL")
    counts = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct(F.col("n"))).alias("m")
    heads = counts.groupBy("name").agg(best, F.count(F.lit(1)).alias("unique"))
    # the smallest value among the most frequent ones
    tops = (
        counts.join(F.broadcast(heads), "name")  # one row per column
        .where(F.col("n") == F.col("m.n"))
        .groupBy("name", "unique")
        .agg(F.min("value").alias("top"), F.max("n").alias("freq"))
    )
    return tops


def describe_table(panel: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles, max of numeric columns; unique, top, freq of text columns."""
    nums = numeric_columns(panel)
    texts = [f.name for f in panel.schema.fields if isinstance(f.dataType, T.StringType)]
    one = panel.agg(
        *[
            F.struct(
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            ).alias(c)
            for c in nums
        ]
    )
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("s")) for c in nums])
    stats = one.select(F.explode(items).alias("x")).select("x.name", "x.s.*")
    q = quantiles(panel, nums, [0.25, 0.5, 0.75])
    q = q.groupBy("name").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    )
    numeric = stats.join(F.broadcast(q), "name", "left")
    text = _text_stats(panel, texts)
    filled = panel.agg(*[F.count(c).alias(c) for c in texts])
    text = stacked(filled, "name", "count", [(c, F.col(c)) for c in texts]).join(F.broadcast(text), "name", "left")
    return numeric.unionByName(text, allowMissingColumns=True)


def missing_report(df: DataFrame) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = stacked(one, "column", "missing", [(c, F.col(c)) for c in df.columns], keep=["__n"])
    return long.select(
        "column", "missing", F.round(F.try_divide(F.col("missing") * 100.0, F.col("__n")), 2).alias("missing_pct")
    ).orderBy(F.col("missing").desc(), "column")


def column_profile(df: DataFrame) -> DataFrame:
    """Type class, filled and missing counts, exact distinct count and the type's own figures."""

    def kind(t):
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "datetime"
        if isinstance(t, T.BooleanType):
            return "boolean"
        return "numeric" if isinstance(t, T.NumericType) else "object"

    kinds = {f.name: kind(f.dataType) for f in df.schema.fields}
    null = F.lit(None)

    def of(c):
        num, low = kinds[c] == "numeric", kinds[c] in ("numeric", "datetime")
        return F.struct(
            F.lit(kinds[c]).alias("kind"),
            F.count(c).alias("non_null"),
            F.count_if(F.col(c).isNull()).alias("missing"),
            (F.min(c).cast("string") if low else null.cast("string")).alias("low_text"),
            (F.min(c).cast("double") if num else null.cast("double")).alias("min"),
            (F.max(c).cast("double") if num else null.cast("double")).alias("max"),
            (F.avg(c) if num else null.cast("double")).alias("mean"),
            (F.stddev_samp(c) if num else null.cast("double")).alias("std"),
        ).alias(c)

    one = df.agg(F.count(F.lit(1)).alias("__n"), *[of(c) for c in df.columns])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in df.columns])
    stats = one.select("__n", F.explode(items).alias("x")).select("__n", "x.column", "x.s.*")
    tops = _text_stats(df, df.columns).withColumnRenamed("name", "column")
    texts = [c for c in df.columns if kinds[c] in ("object", "boolean")]
    out = stats.join(F.broadcast(tops), "column", "left")
    keep = F.col("column").isin(texts)
    return out.select(
        "column", "kind", "non_null", "missing",
        F.round(F.try_divide(F.col("missing") * 100.0, F.col("__n")), 2).alias("missing_pct"),
        F.coalesce("unique", F.lit(0)).alias("unique"), "min", "max", "mean", "std",
        F.when(keep, F.col("top")).alias("top"), F.when(keep, F.col("freq")).alias("freq"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row in full."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def table_health(df: DataFrame, date: str = TIME) -> DataFrame:
    cells = len(df.columns)
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns[1:]), F.count_if(F.col(df.columns[0]).isNull()))
    one = df.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("missing_cells"), F.max(date).alias("latest"))
    share = F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, F.col("rows") * cells), F.lit(0.0))
    return (
        one.withColumn("columns", F.lit(cells))
        .withColumn("missing_pct", F.round(share, 2))
        .withColumn("completeness_pct", 100 - F.col("missing_pct"))
        .withColumn("duplicate_rows", duplicate_rows(df).scalar())
        .withColumn(
            "status",
            F.when(F.col("missing_pct") < 5, "Excellent").when(F.col("missing_pct") < 15, "Good").otherwise("Needs Attention"),
        )
    )


def quick_summary(df: DataFrame, n: int = 5) -> DataFrame:
    """Rows, columns, date span, products and the largest categories; columns found by name."""

    def find(*terms):
        return next((c for c in df.columns if any(t in c.lower() for t in terms)), None)

    date, product, category = find("date", "week"), find("product", "sku", "item"), find("category", "dept")
    top = df.groupBy(category).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), category).limit(n)
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(category).alias("v")))).alias("l"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.count_distinct(product).alias("products"),
    ).withColumn("top_categories", F.array_join(listed.scalar()["v"], ", "))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in cols])


def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), col).limit(n)


def exec_kpis(panel: DataFrame, alerts: DataFrame) -> DataFrame:
    levels = alerts.agg(
        F.count_if(F.col("urgency") == "CRITICAL").alias("critical"),
        F.count_if(F.col("urgency") == "WARNING").alias("warning"),
        F.count_if(F.col("urgency") == "OVERSTOCK").alias("overstock"),
    )
    main = panel.agg(
        F.count_distinct(KEY).alias("products"),
        F.sum("sales_qty").alias("total_qty"),
        F.sum(_revenue()).alias("total_revenue"),
        F.avg("price").alias("avg_price"),
    )
    return with_scalars(main, levels)


def completion_report(**tables: DataFrame) -> DataFrame:
    """Row counts of the result tables in one row."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n") for k, t in tables.items()]
    stack = parts[0]
    for p in parts[1:]:
        stack = stack.unionByName(p)
    return stack.groupBy().pivot("k", list(tables)).agg(F.max("n"))


def weekly_totals(panel: DataFrame) -> DataFrame:
    return panel.groupBy(TIME).agg(F.sum("sales_qty").alias("total_qty"))


def monthly_counts(panel: DataFrame) -> DataFrame:
    return panel.groupBy(F.date_format(TIME, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def category_totals(panel: DataFrame, n: int = 8) -> DataFrame:
    return (
        panel.groupBy("category").agg(F.sum("sales_qty").alias("total_qty"))
        .orderBy(F.col("total_qty").desc(), "category").limit(n)
    )


def product_price_volume(panel: DataFrame) -> DataFrame:
    return panel.groupBy(KEY).agg(F.avg("price").alias("mean_price"), F.sum("sales_qty").alias("total_qty"))


def topk_products(df: DataFrame, k: int = 20) -> DataFrame:
    return (
        df.groupBy(KEY).agg(F.sum(_revenue()).alias("total_revenue"))
        .orderBy(F.col("total_revenue").desc(), KEY).limit(k)
    )


def semi_top_products(df: DataFrame, n: int = 20) -> DataFrame:
    # n rows on the broadcast side
    return df.join(F.broadcast(topk_products(df, n).select(KEY)), KEY, "left_semi")


def months_of(df: DataFrame) -> list[str]:
    """Calendar months between the first and the last date: the pivot's columns."""
    lo, hi = df.agg(F.min(TIME), F.max(TIME)).first()
    if lo is None:
        return []
    first, last = lo.year * 12 + lo.month - 1, hi.year * 12 + hi.month - 1
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(first, last + 1)]


def pivot_revenue(df: DataFrame, n: int = 20) -> DataFrame:
    """Product x month revenue of the largest products, 0 where nothing was sold."""
    rows = semi_top_products(df, n).withColumn("month", F.date_format(TIME, "yyyy-MM"))
    return rows.groupBy(KEY).pivot("month", months_of(df)).agg(F.sum(_revenue())).fillna(0.0)


def pivot_month_week(df: DataFrame, last: int | None = 52) -> DataFrame:
    """Month x ISO week mean quantity per product, over the last rows of each product or all."""
    rows = df
    if last is not None:
        w = Window.partitionBy(KEY).orderBy(F.col(TIME).desc())
        rows = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= last)
    weeks = list(range(1, 54))
    rows = rows.select(KEY, F.month(TIME).alias("month"), F.weekofyear(TIME).alias("week"), "sales_qty")
    out = rows.groupBy(KEY, "month").pivot("week", weeks).agg(F.avg("sales_qty")).fillna(0.0)
    return out.withColumnsRenamed({str(w): f"w{w}" for w in weeks})


def pivot_anomaly(anoms: DataFrame) -> DataFrame:
    """Product x month mean absolute deviation."""
    rows = anoms.select(KEY, F.month("date").alias("month"), F.abs("deviation_pct").alias("d"))
    out = rows.groupBy(KEY).pivot("month", list(range(1, 13))).agg(F.avg("d"))
    return out.withColumnsRenamed({str(m): f"m{m}" for m in range(1, 13)})


def month_means(panel: DataFrame) -> DataFrame:
    return panel.groupBy(KEY, F.month(TIME).alias("month")).agg(F.avg("sales_qty").alias("mean_qty"))


def topk_months(panel: DataFrame, k: int = 3) -> DataFrame:
    """The k highest and k lowest months per product (twelve rows a product at most)."""
    means = month_means(panel)
    high = F.row_number().over(Window.partitionBy(KEY).orderBy(F.col("mean_qty").desc(), "month"))
    low = F.row_number().over(Window.partitionBy(KEY).orderBy(F.col("mean_qty").asc(), "month"))
    ranked = means.withColumns({"high_rank": high, "low_rank": low})
    return ranked.filter((F.col("high_rank") <= k) | (F.col("low_rank") <= k))


def month_profile(panel: DataFrame) -> DataFrame:
    """Peak and low month per product against the mean of its monthly means."""
    m = month_means(panel).groupBy(KEY).agg(
        F.min_by("month", F.struct(-F.col("mean_qty"), "month")).alias("peak_month"),
        F.min_by("month", F.struct("mean_qty", "month")).alias("low_month"),
        F.max("mean_qty").alias("peak_qty"),
        F.min("mean_qty").alias("low_qty"),
        F.avg("mean_qty").alias("mean_of_means"),
    )
    m = m.withColumn("peak_pct", pct("peak_qty", "mean_of_means")).withColumn(
        "low_pct", -pct("low_qty", "mean_of_means")
    )
    m = m.withColumn("variation", F.abs(F.col("peak_pct") - F.col("low_pct")))
    return m.withColumn("strength", F.when(F.col("variation") > 30, "strong").otherwise("moderate"))


def year_week_compare(panel: DataFrame) -> DataFrame:
    """Mean quantity by year and ISO week for the last two years with data."""
    means = panel.groupBy(F.year(TIME).alias("year"), F.weekofyear(TIME).alias("week")).agg(
        F.avg("sales_qty").alias("mean_qty")
    )
    years = means.select("year").distinct().orderBy(F.col("year").desc()).limit(2)
    return means.join(F.broadcast(years), "year", "left_semi")  # two rows


def category_seasonality(panel: DataFrame) -> DataFrame:
    by_season = season_from_month(panel).groupBy("category", "season").agg(F.avg("sales_qty").alias("m"))
    out = by_season.groupBy("category").agg(
        F.min_by("season", F.struct(-F.col("m"), "season")).alias("peak_season"),
        F.max("m").alias("peak_qty"),
        F.min_by("season", F.struct("m", "season")).alias("low_season"),
        F.min("m").alias("low_qty"),
        F.count(F.lit(1)).alias("n"),
    )
    out = out.filter("n > 1 AND low_qty > 0").withColumn("variation_pct", pct("peak_qty", "low_qty"))
    v = F.col("variation_pct")
    level = F.when(v > 50, "HIGH").when(v > 25, "MODERATE").otherwise("LOW")
    advice = F.when(v > 50, F.concat(F.lit("Raise stock by 40-60% before "), F.col("peak_season"))).when(
        v > 25, F.concat(F.lit("Plan a 25-40% stock boost for "), F.col("peak_season"))
    ).otherwise("Keep stock steady")
    return out.drop("n").withColumns({"level": level, "recommendation": advice})


def flag_correlations(panel: DataFrame) -> DataFrame:
    return panel.groupBy(KEY).agg(
        corr("sales_qty", "promotion").alias("promotion_corr"), corr("sales_qty", "holiday_flag").alias("holiday_corr")
    )


def importance_rollup(imps: DataFrame, weights: DataFrame | None = None, n: int = 15) -> DataFrame:
    """Mean importance per feature, or the sum over models of importance x model weight."""
    if weights is None:
        out = imps.groupBy("feature").agg(F.avg("importance").alias("importance"))
    else:
        out = imps.join(F.broadcast(weights), "model").groupBy("feature").agg(
            F.sum(F.col("importance") * F.col("weight")).alias("importance")
        )  # weights: one row per model
    return out.orderBy(F.col("importance").desc(), "feature").limit(n)


def alert_level_counts(alerts: DataFrame, panel: DataFrame) -> DataFrame:
    has = lambda t: F.count_if(F.col("status").contains(t))
    counts = alerts.agg(has("Low").alias("low_stock"), has("Over").alias("overstock"), has("Optimal").alias("optimal"))
    products = panel.agg(F.count_distinct(KEY).alias("products"))
    out = with_scalars(counts, products)
    return out.withColumn("health_pct", F.coalesce(F.try_divide(F.col("optimal") * 100.0, F.col("products")), F.lit(0.0)))


def ab_test(results: DataFrame, control: str = "control_price") -> DataFrame:
    """Control and variant revenue per product, the best variant and the sample size."""
    by_price = results.groupBy("product_id", "price").agg(
        F.sum("revenue").alias("s"), F.count(F.lit(1)).alias("n"), F.max(control).alias("control_price")
    )
    is_control = F.coalesce(F.col("price") == F.col("control_price"), F.lit(False))
    out = by_price.withColumn("m", F.col("s") / F.col("n")).groupBy("product_id").agg(
        F.sum("n").alias("sample_size"),
        F.max("control_price").alias("control_price"),
        F.max(F.when(is_control, F.col("m"))).alias("control_revenue"),
        F.count_if(~is_control).alias("variants"),
        F.max(F.when(~is_control, F.col("m"))).alias("best_revenue"),
        F.min_by("price", F.when(~is_control, F.struct(-F.col("m"), "price"))).alias("best_variant"),
    )
    few = F.col("sample_size") < 2
    return out.withColumn("status", F.when(few, "Insufficient data").otherwise("ok")).withColumn(
        "winner", F.when(few, None).otherwise(F.coalesce("best_variant", "control_price"))
    )


def distinct_name_map(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(a, b).distinct()


def distinct_values(df: DataFrame, col: str = KEY) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def sort_abs(df: DataFrame, col: str, n: int, *tie: str) -> DataFrame:
    return df.orderBy(F.abs(col).desc(), *tie).limit(n)


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """A repeatable random sample of n rows: the n smallest hashes."""
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(n)


def union_placeholder(df: DataFrame, row: dict) -> DataFrame:
    """`df`, or one literal row of the same schema when it is empty."""
    none = df.limit(1).agg(F.count(F.lit(1)).alias("n"))
    filler = none.filter("n = 0").select(
        *[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    )
    return df.unionByName(filler)


def union_models(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    return a.withColumn("model", F.lit(names[0])).unionByName(b.withColumn("model", F.lit(names[1])))


def union_products(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def join_product_summary(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Per-product figures back on the rows; Spark broadcasts the summary while it is small."""
    return df.join(summary.select(KEY, "avg_price", "avg_sales", "price_variability"), KEY, "left")


def join_spine(df: DataFrame, spine: DataFrame, on: list[str]) -> DataFrame:
    return spine.join(df, on, "left")


def join_reindex(driver: DataFrame, pred: DataFrame, on: list[str]) -> DataFrame:
    return driver.join(pred, on, "left")


def join_actual_fitted(hist: DataFrame, fitted: DataFrame) -> DataFrame:
    return hist.join(fitted, [KEY, TIME], "left")


def join_anomaly_context(anoms: DataFrame, panel: DataFrame) -> DataFrame:
    """Correlation of deviation with price and stock per product, when more than 3 anomalies."""
    rows = anoms.select(KEY, F.col("date").alias(TIME), "deviation_pct").join(
        panel.select(KEY, TIME, "price", "stock_on_hand"), [KEY, TIME]
    )
    return (
        rows.groupBy(KEY)
        .agg(
            F.count(F.lit(1)).alias("n"),
            corr("deviation_pct", "price").alias("price_corr"),
            corr("deviation_pct", "stock_on_hand").alias("stock_corr"),
        )
        .filter("n > 3")
    )


def join_first_match(anoms: DataFrame, panel: DataFrame) -> DataFrame:
    """Price, stock, promotion and holiday of the anomaly's own week."""
    cols = ["price", "stock_on_hand", "promotion", "holiday_flag"]
    first = panel.groupBy(KEY, F.col(TIME).alias("date")).agg(*[F.first(c, ignorenulls=False).alias(c) for c in cols])
    return anoms.join(first, [KEY, "date"], "left")


def semi_alert_products(alerts: DataFrame, panel: DataFrame) -> DataFrame:
    return alerts.join(panel.select(KEY).distinct(), KEY, "left_semi")


def cross_scalar(df: DataFrame, agg: DataFrame) -> DataFrame:
    return with_scalars(df, agg)


def scalar_of(df: DataFrame):
    return one_row(df)
