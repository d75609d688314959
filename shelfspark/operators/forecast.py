"""Decomposition, closed-form forecasts, blending, scoring and scenario evaluation.

Histories are (product_name, week_start, sales_qty) rows; forecasts are (product_name,
step 1.., date, yhat, bounds) rows. Every group is one product's calendar.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY, TIME, by, clip_col, each, newest_first, ordered, stacked, with_scalars
from shelfspark.functions.linear import dot, least_squares
from shelfspark.functions.local import bisquare, line_at, near_moments, one_period, tricube
from shelfspark.operators.cleaning import resample_weekly
from shelfspark.operators.windows import half_trend, last_n_mean
from shelfspark.session import written

EPS = 1e-6
SCALE = 1_000_000  # integer units of one period in the variable-width frames
RIDGE = 1e-6  # penalty that keeps the two regressions of the moving-average model solvable
TREND, LEAST_WEIGHT = 0.955, 1e-4  # periods on each side of a local trend; weight of a residual of six medians
# Interval widths, blend prior, harmonic periods in days with their orders,
# scenario multipliers and named growth scenarios.
Z80, Z95 = 1.28, 1.96
BASE_WEIGHTS = {"prophet": 0.4, "xgb": 0.3, "lgbm": 0.3}
TERMS = {"yearly": (365.25, 10, 0), "quarterly": (91.25, 3, 26), "monthly": (30.5, 5, 52)}
PROMO, HOLIDAY, INTENSITY = 1.2, 1.25, 0.20
WEATHER = {"Sunny": 1.15, "Rainy": 0.90, "Cloudy": 1.0, "Stormy": 0.75}
GROWTH_SCENARIOS = [("optimistic", 0.15, 1.2), ("pessimistic", -0.10, 0.8), ("steady_growth", 0.05, 1.0)]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def month_name(c) -> Column:
    return F.get(F.array(*[F.lit(m) for m in MONTHS]), F.col(c) - 1 if isinstance(c, str) else c - 1)


# ---- decomposition


def decompose_classical(df: DataFrame, period: int = 52, model: str = "multiplicative", min_n: int = 52) -> DataFrame:
    """Trend, seasonal and residual of each product's weekly sums.

    The period is min(period, n // 2), so it differs by product; the centred average is a
    range frame over positions measured in periods, with half weights at both ends when the
    period is even. Multiplicative needs positive values throughout.
    """
    weekly = resample_weekly(df.select(KEY, F.col(TIME).alias("date"), "sales_qty"))
    return _decompose(weekly, period, model, min_n)


def decompose_additive(df: DataFrame, period: int = 7) -> DataFrame:
    """Additive decomposition of a regular (product_name, date, sales_qty) series."""
    return _decompose(df, period, "additive", 2 * period)


def decompose_robust(series: DataFrame, period: int = 7, inner: int = 2, robust: int = 1, cycles: int = 3, min_n: int | None = None) -> DataFrame:
    """Trend, seasonal and residual by local regression that outliers hardly move.

    `series` is a regular (product_name, date, sales_qty). A pass smooths each slot of the period over `cycles` cycles on
    both sides, takes the running mean of one period off it, and smooths what is left of the sales over `TREND` periods
    on both sides; `inner` passes refine the trend. Then rows are weighted down by their residual (bisquare of six
    medians, beyond it `LEAST_WEIGHT` and less) and the passes repeated, `robust` times. The period is min(period, n // 2);
    products with fewer than `min_n` rows (two periods unless given) are left out. All steps share one shuffle.
    """
    i, p, y = F.col("i"), F.col("period"), F.col("sales_qty")
    s = series.select(KEY, "date", F.col("sales_qty").cast("double").alias("sales_qty")).withColumns(
        {"n": F.count(F.lit(1)).over(by()), "i": F.row_number().over(ordered(KEY, "date")) - 1}
    )
    s = s.filter(F.col("n") >= (2 * period if min_n is None else min_n))
    s = s.withColumn("period", F.least(F.lit(period), F.floor(F.col("n") / 2)).cast("int"))
    s = s.withColumns({"slot": i % p, "cycle": F.floor(i / p).cast("int"), "trend": F.lit(0.0), "weight": F.lit(1.0)})
    half, widest, sums = F.floor(p * F.lit(TREND)) + 1, int(period * TREND) + 1, ("s0", "s1", "s2", "t0", "t1")
    for outer in range(robust + 1):
        for _ in range(inner):
            s = near_moments(s, [KEY, "slot"], "cycle", y - F.col("trend"), F.col("weight"), tricube(F.lit(cycles)), cycles)
            s = s.withColumn("cyclic", line_at()).drop(*sums, "trend", "seasonal")
            s = near_moments(s, [KEY], "i", F.col("cyclic"), F.lit(1.0), one_period(p), period // 2)
            s = s.withColumn("level", F.when(F.col("s0") == p, F.col("t0") / p))  # null where a period does not fit
            placed = F.when(F.col("level").isNotNull(), i)
            s = s.withColumns({"first": F.min_by("level", placed).over(by()), "last": F.max_by("level", placed).over(by())})
            level = F.coalesce("level", F.when(2 * i < F.col("n"), F.col("first")).otherwise(F.col("last")))
            s = s.withColumn("seasonal", F.col("cyclic") - level).drop(*sums, "cyclic", "level", "first", "last")
            s = near_moments(s, [KEY], "i", y - F.col("seasonal"), F.col("weight"), tricube(half), widest)
            s = s.withColumn("trend", line_at()).drop(*sums)
        s = s.withColumn("resid", y - F.col("seasonal") - F.col("trend"))
        if outer < robust:
            scale = 6 * F.median(F.abs("resid")).over(by())
            s = s.withColumn("scale", scale).withColumn("weight", bisquare(F.col("resid"), F.col("scale"), LEAST_WEIGHT)).drop("scale", "resid")
    return s.select(KEY, "date", "sales_qty", "trend", "seasonal", "resid", "weight")


def _decompose(series: DataFrame, period: int, model: str, min_n: int) -> DataFrame:
    mult = model == "multiplicative"
    p, y = F.col("period"), F.col("sales_qty")
    s = series.select(KEY, "date", "sales_qty").withColumns(
        {"n": F.count(F.lit(1)).over(by()), "low": F.min("sales_qty").over(by()), "i": F.row_number().over(ordered(KEY, "date")) - 1}
    )
    s = s.filter(F.col("n") >= min_n)
    if mult:
        s = s.filter("low > 0")
    s = s.withColumn("period", F.least(F.lit(period), F.floor(F.col("n") / 2)).cast("int"))
    s = s.withColumn("at", F.floor(F.col("i").cast("bigint") * SCALE / p).cast("bigint"))
    half = SCALE // 2 + 10  # ten units absorb the rounding of `at`
    w = by().orderBy("at").rangeBetween(-half, half)
    even = p % 2 == 0
    ends = F.when(even, 0.5 * (F.first("sales_qty").over(w) + F.last("sales_qty").over(w))).otherwise(0.0)
    s = s.withColumn("trend", F.when(F.count(F.lit(1)).over(w) == p + F.when(even, 1).otherwise(0), (F.sum("sales_qty").over(w) - ends) / p))
    s = s.withColumns({"detrended": y / F.col("trend") if mult else y - F.col("trend"), "slot": F.col("i") % p})
    s = s.withColumn("mean", F.avg("detrended").over(by([KEY, "slot"])))
    first_round = F.when(F.col("i") < p, F.col("mean"))
    level = F.avg(first_round).over(by())
    s = s.withColumn("seasonal", F.col("mean") / level if mult else F.col("mean") - level)
    resid = y / (F.col("seasonal") * F.col("trend")) if mult else y - F.col("seasonal") - F.col("trend")
    return s.select(KEY, "date", "sales_qty", "trend", "seasonal", resid.alias("resid"))


def seasonality_mode(panel: DataFrame) -> DataFrame:
    out = panel.groupBy(KEY).agg(F.avg("sales_qty").alias("mean"), F.stddev_samp("sales_qty").alias("std"))
    cv = F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.5)
    return out.withColumn("cv", cv).withColumn("mode", F.when(F.col("cv") > 0.3, "multiplicative").otherwise("additive"))


# ---- forecasts


def ahead(df: DataFrame, horizon: int, start: str = "last", days: int = 7) -> DataFrame:
    """One row per future step after the date in `start`."""
    steps = F.sequence(F.lit(1), F.lit(horizon))
    out = df.withColumn("step", F.explode(steps))
    return out.withColumn("date", F.date_add(F.col(start), F.col("step") * days))


def forecast_moving_average(series: DataFrame, horizon: int = 14) -> DataFrame:
    """Fitted trailing means of width min(7, n // 3) and a flat future with +-1.96 deviations."""
    s = series.select(KEY, "date", "sales_qty").withColumns(
        {"n": F.count(F.lit(1)).over(by()), "sd": F.stddev_samp("sales_qty").over(by()),
         "i": F.row_number().over(ordered(KEY, "date")), "age": F.row_number().over(newest_first(KEY, "date"))}
    )
    s = s.withColumn("width", F.greatest(F.lit(1), F.least(F.lit(7), F.floor(F.col("n") / 3))).cast("int"))
    s = s.withColumn("at", F.floor(F.col("i").cast("bigint") * SCALE / F.col("width")).cast("bigint"))
    back = by().orderBy("at").rangeBetween(-(SCALE - SCALE // 20), 0)  # width rows for widths up to 19
    fitted = s.withColumn("yhat", F.avg("sales_qty").over(back)).withColumn("kind", F.lit("fitted"))
    tail = s.groupBy(KEY).agg(
        F.max("date").alias("last"), F.max("sd").alias("sd"),
        F.avg(F.when(F.col("age") <= F.col("width"), F.col("sales_qty"))).alias("yhat"),
    )
    future = ahead(tail, horizon, days=1).withColumn("kind", F.lit("forecast"))
    cols = [KEY, "date", "kind", "yhat", (F.col("yhat") - Z95 * F.col("sd")).alias("yhat_lower"),
            (F.col("yhat") + Z95 * F.col("sd")).alias("yhat_upper")]
    return fitted.select(*cols).unionByName(future.select(*cols))


def forecast_damped_trend(series: DataFrame, horizon: int = 28) -> DataFrame:
    """Weekly mean moved by a tenth of the half-to-half trend, one row per future ISO week and year."""
    stats = half_trend(series).join(
        series.groupBy(KEY).agg(F.avg("sales_qty").alias("mean"), F.max(TIME).alias("last")), KEY
    )
    days = ahead(stats, horizon, days=1)
    weeks = days.groupBy(KEY, "mean", "half_trend", F.weekofyear("date").alias("week"), F.year("date").alias("year")).agg(
        F.min("date").alias("date")
    )
    value = F.greatest(F.lit(0.0), F.col("mean") * (1 + F.col("half_trend") * 0.1))
    return weeks.select(KEY, "date", value.alias("yhat"), (value * 0.8).alias("yhat_lower"), (value * 1.2).alias("yhat_upper"))


def forecast_ma_bounds(series: DataFrame, horizon: int = 12) -> DataFrame:
    """Flat 4-week mean with bounds from the 4- and 8-week means."""
    age = series.withColumn("age", F.row_number().over(newest_first()))
    last = lambda k: F.avg(F.when(F.col("age") <= k, F.col("sales_qty")))
    m = age.groupBy(KEY).agg(
        F.max(TIME).alias("last"), F.count(F.lit(1)).alias("n"), last(4).alias("m4"), last(8).alias("m8")
    ).withColumn("m8", F.when(F.col("n") >= 8, F.col("m8")).otherwise(F.col("m4")))
    return ahead(m, horizon).select(
        KEY, "step", "date", F.col("m4").alias("yhat"), (F.col("m8") * 0.7).alias("yhat_lower"), (F.col("m4") * 1.3).alias("yhat_upper"),
        (F.col("m8") * 0.5).alias("yhat_lower_95"), (F.col("m4") * 1.5).alias("yhat_upper_95"),
    )


def forecast_ar(panel: DataFrame, horizon: int = 4) -> DataFrame:
    """AR(1) on first differences with its closed h-step sum, and errors on the last `horizon` weeks."""
    d = panel.select(KEY, TIME, "sales_qty", (F.col("sales_qty") - F.lag("sales_qty").over(ordered())).alias("d"))
    d = d.withColumns({"lag_d": F.lag("d").over(ordered()), "prev": F.lag("sales_qty").over(ordered()),
                       "age": F.row_number().over(newest_first())})
    fit = d.groupBy(KEY).agg(
        F.regr_slope("d", "lag_d").alias("b"), F.regr_intercept("d", "lag_d").alias("a"), F.max(TIME).alias("last"),
        F.max_by("sales_qty", TIME).alias("y"), F.max_by("d", TIME).alias("last_d"), F.count("lag_d").alias("pairs"),
    ).filter("pairs >= 3")
    recent = d.filter(F.col("age") <= horizon).join(fit.select(KEY, "a", "b"), KEY)
    miss = F.col("sales_qty") - (F.col("prev") + F.col("a") + F.col("b") * F.col("lag_d"))
    errors = recent.groupBy(KEY).agg(F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"))
    out = ahead(fit.join(errors, KEY), horizon)
    h, a, b = F.col("step"), F.col("a"), F.col("b")
    mu = a / (1 - b)
    total = h * mu + (F.col("last_d") - mu) * b * (1 - F.pow(b, h)) / (1 - b)
    return out.select(KEY, "step", "date", (F.col("y") + total).alias("yhat"), "mae", "rmse")


def forecast_arma(panel: DataFrame, horizon: int = 4, long: int = 4, least: int = 20) -> DataFrame:
    """ARIMA(1,1,1) per product in two regressions, with errors on the last `horizon` weeks and the information criterion.

    First weekly changes are regressed on their `long` predecessors; then on the last change and that regression's last
    residual, which stands for the shock. Both are normal equations summed per product. Products with fewer than `least`
    changes, or whose second regression is not stationary or not invertible, get AR(1) on the levels instead
    (`model` tells which); products with fewer than three pairs of weeks, or constant ones, are left out.
    """
    w = ordered()
    rows = panel.select(KEY, TIME, F.col("sales_qty").cast("double").alias("y")).where(F.col("y").isNotNull())
    rows = rows.withColumns({"prev": F.lag("y").over(w), "age": F.row_number().over(newest_first())})
    rows = rows.withColumn("d", F.col("y") - F.col("prev"))
    rows = written(rows.withColumn("past", F.array(F.lit(1.0), *[F.lag("d", k).over(w) for k in range(1, long + 1)])), "changes")
    full = F.col("past")[long].isNotNull()
    first = least_squares(rows.where(full), [KEY], F.col("past"), F.col("d"), long + 1, [0.0] + [RIDGE] * long).withColumnRenamed("coef", "first")
    shocks = rows.join(first, KEY, "left").withColumn("e", F.when(full, F.col("d") - dot(F.col("past"), F.col("first"))))
    pair = F.array(F.lit(1.0), F.lag("d").over(w), F.lag("e").over(w))
    shocks = written(shocks.select(KEY, TIME, "y", "prev", "d", "e", "age", pair.alias("pair")), "shocks")
    both = F.col("pair")[2].isNotNull()
    second = least_squares(shocks.where(both), [KEY], F.col("pair"), F.col("d"), 3, [0.0, RIDGE, RIDGE])
    level = shocks.groupBy(KEY).agg(
        F.regr_slope("y", "prev").alias("slope"), F.regr_intercept("y", "prev").alias("base"), F.count("prev").alias("pairs"), F.count(F.when(both, 1)).alias("changes"),
        F.max(TIME).alias("last"), F.max_by("y", TIME).alias("y"), F.max_by("d", TIME).alias("d"), F.max_by("e", TIME).alias("e"),
    )
    fit = level.join(second, KEY, "left")
    sound = (F.col("changes") >= least) & (F.abs(F.col("coef")[1]) < 1) & (F.abs(F.col("coef")[2]) < 1)
    fit = fit.withColumn("moving", F.coalesce(sound, F.lit(False))).where("moving OR (pairs >= 3 AND slope IS NOT NULL)")
    fit = written(fit, "arma")

    ahead_of = F.when(F.col("moving"), F.col("prev") + dot(F.col("pair"), F.col("coef"))).otherwise(F.col("base") + F.col("slope") * F.col("prev"))
    miss = F.col("y") - ahead_of
    scored = shocks.join(fit.select(KEY, "coef", "moving", "base", "slope"), KEY).withColumn("r", miss)
    recent, n = F.when(F.col("age") <= horizon, F.col("r")), F.count("r")
    errors = scored.groupBy(KEY).agg(
        F.avg(F.abs(recent)).alias("mae"), F.sqrt(F.avg(recent * recent)).alias("rmse"),
        (n * F.log(F.sum(F.col("r") * F.col("r")) / n) + 2 * F.when(F.max("moving"), 3).otherwise(2)).alias("aic"),
    )
    # change by change: the shock is known for the first step only
    c, phi, theta = (F.col("coef")[k] for k in range(3))
    h, start = F.col("step"), F.col("coef")[0] + F.col("coef")[1] * F.col("d") + F.col("coef")[2] * F.col("e")
    mu = c / (1 - phi)
    changes = F.col("y") + h * mu + (start - mu) * (1 - F.pow(phi, h)) / (1 - phi)
    steps = F.aggregate(F.sequence(F.lit(1), h), F.col("y"), lambda v, _: F.col("base") + F.col("slope") * v)
    out = ahead(fit.join(errors, KEY), horizon)
    return out.select(
        KEY, "step", "date", F.when(F.col("moving"), "ARIMA(1,1,1)").otherwise("ARIMA(1,0,0)").alias("model"),
        F.when(F.col("moving"), changes).otherwise(steps).alias("yhat"), "mae", "rmse", "aic",
        F.when(F.col("moving"), phi).otherwise(F.col("slope")).alias("phi"), F.when(F.col("moving"), theta).alias("theta"),
    )


def trend_fit(panel: DataFrame, monthly: bool) -> DataFrame:
    """Straight line over weeks per product, times the month's share of the mean when `monthly`."""
    start = F.min(TIME).over(by())
    rows = panel.select(KEY, TIME, "sales_qty").withColumns({"start": start, "t": F.datediff(F.col(TIME), start) / 7})
    line = rows.groupBy(KEY).agg(
        F.regr_slope("sales_qty", "t").alias("slope"), F.regr_intercept("sales_qty", "t").alias("base"),
        F.avg("sales_qty").alias("mean"), F.min("start").alias("start"), F.max(TIME).alias("last"),
    )
    if monthly:
        months = rows.groupBy(KEY, F.month(TIME).alias("m")).agg(F.avg("sales_qty").alias("mm"))
        months = months.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("m", "mm"))).alias("months"))  # 12 entries
        line = line.join(months, KEY)
    return line


def trend_value(date: str, monthly: bool) -> Column:
    """Value of the fitted line (columns of `trend_fit`) at a date, not below 0."""
    y = F.col("base") + F.col("slope") * (F.datediff(F.col(date), "start") / 7)
    if monthly:
        y = y * F.coalesce(F.try_divide(F.try_element_at("months", F.month(date)), F.col("mean")), F.lit(1.0))
    return F.greatest(F.lit(0.0), y)


def forecast_trend_season(panel: DataFrame, horizon: int = 60, mode: str = "monthly", holiday: Callable[[Column], Column] | None = None) -> DataFrame:
    """Forecast with 80 % and 95 % intervals from the population deviation of the residuals.

    "trend" is a line, "monthly" a line times month shares (both plain aggregates),
    "harmonic" is `forecast_regression` with all terms, where `holiday` tells the holidays of future dates.
    """
    if mode == "harmonic":
        return forecast_regression(panel, horizon, holiday)
    monthly = mode == "monthly"
    fit = trend_fit(panel, monthly)
    resid = panel.select(KEY, TIME, "sales_qty").join(fit, KEY).withColumn("r", F.col("sales_qty") - trend_value(TIME, monthly))
    sd = resid.groupBy(KEY).agg(F.stddev_pop("r").alias("sd"))
    out = ahead(fit.join(sd, KEY), horizon).withColumn("yhat", trend_value("date", monthly))
    return out.select(KEY, "step", "date", "yhat", *bounds("yhat", "sd"))


def bounds(y: str, sd: str) -> list[Column]:
    c, s = F.col(y), F.col(sd)
    return [
        F.greatest(F.lit(0.0), c - Z80 * s).alias("yhat_lower"), (c + Z80 * s).alias("yhat_upper"),
        F.greatest(F.lit(0.0), c - Z95 * s).alias("yhat_lower_95"), (c + Z95 * s).alias("yhat_upper_95"),
    ]


def _terms(terms: dict[str, tuple[float, int, int]]) -> int:
    return sum(2 * order for _, order, _ in terms.values())


def _design(day: Column, span: Column, n: Column, holiday: Column, promotion: Column, terms: dict, bends: int, effects: bool) -> Column:
    """Features of a day counted from a product's first: line, bends of the line, harmonics (0 where the history is too short), effects."""
    years = day / 365.25
    cols = [F.lit(1.0), years]
    for k in range(1, bends + 1):
        cols.append(F.greatest(years - span * (0.8 * k / (bends + 1)) / 365.25, F.lit(0.0)))
    for period, order, least in terms.values():
        for k in range(1, order + 1):
            angle = day * (2 * math.pi * k / period)
            cols += [F.when(n > least, f(angle)).otherwise(0.0) for f in (F.sin, F.cos)]
    if effects:
        cols += [holiday.cast("double"), promotion.cast("double")]
    return F.array(*[c.cast("double") for c in cols])


def forecast_regression(
    panel: DataFrame, horizon: int, holiday: Callable[[Column], Column] | None = None, terms: dict | None = None,
    bends: int = 5, effects: bool = True, least: int = 10, logs: bool = True,
) -> DataFrame:
    """Ridge regression per product on a line that may bend, Fourier terms, holiday and promotion, for all products in one plan.

    The normal equations are sums per product, solved in column expressions; a product's rows are not gathered. `holiday` gives
    1 or 0 for a future date (no holidays without it), future weeks have no promotion. Products with fewer than `least` weeks are left out.
    Uneven series of large amounts are fitted in logs if `logs`.
    """
    terms = TERMS if terms is None else terms
    size = 2 + bends + _terms(terms) + (2 if effects else 0)
    penalty = [1e-6, 1e-6] + [0.1] * (size - 2)
    rows_ = panel.select(KEY, TIME, "sales_qty", "holiday_flag", "promotion").where(F.col("sales_qty").isNotNull())
    y, mean = F.col("sales_qty").cast("double"), F.avg("sales_qty").over(by())
    uneven = (F.count("sales_qty").over(by()) > 1) & (mean > 0) & (F.stddev("sales_qty").over(by()) / mean > 0.3) & (F.max("sales_qty").over(by()) > 100)
    rows_ = rows_.withColumns(
        {"start": F.min(TIME).over(by()), "last": F.max(TIME).over(by()), "n": F.count(F.lit(1)).over(by()),
         "logs": F.coalesce(uneven, F.lit(False)) if logs else F.lit(False)}
    ).where(F.col("n") >= least)
    span = F.datediff("last", "start").cast("double")
    x = _design(F.datediff(F.col(TIME), "start").cast("double"), span, F.col("n"), F.col("holiday_flag"), F.col("promotion"), terms, bends, effects)
    rows_ = rows_.withColumns({"x": x, "target": F.when(F.col("logs"), F.log1p(y)).otherwise(y)})
    rows_ = written(rows_.select(KEY, "start", "last", "n", "logs", "x", "target"), "design")
    coef = written(least_squares(rows_, [KEY], F.col("x"), F.col("target"), size, penalty), "coefficients")
    fitted = rows_.join(coef, KEY).withColumn("r", F.col("target") - dot(F.col("x"), F.col("coef")))
    fit = fitted.groupBy(KEY).agg(
        F.stddev_pop("r").alias("sd"), F.max("start").alias("start"), F.max("last").alias("last"), F.max("n").alias("n"), F.max("logs").alias("logs")
    ).join(coef, KEY)
    out = ahead(fit, horizon)
    date = F.col("date")
    future = _design(F.datediff(date, "start").cast("double"), span, F.col("n"), holiday(date) if holiday else F.lit(0), F.lit(0), terms, bends, effects)
    out = out.withColumn("point", dot(future, F.col("coef")))
    back = lambda c: F.greatest(F.lit(0.0), F.when(F.col("logs"), F.expm1(c)).otherwise(c))
    at = lambda z: back(F.col("point") + F.lit(z) * F.col("sd"))
    return out.select(
        KEY, "step", "date", at(0.0).alias("yhat"), at(-Z80).alias("yhat_lower"), at(Z80).alias("yhat_upper"),
        at(-Z95).alias("yhat_lower_95"), at(Z95).alias("yhat_upper_95"),
    )


def forecast_intervals(preds: DataFrame, resid: DataFrame) -> DataFrame:
    """Model bounds widened to +-15 %, or bounds from the residuals where the model has none."""
    sd = resid.groupBy(KEY).agg(F.stddev_pop("residual").alias("sd"))
    df = preds.join(sd, KEY, "left")
    y, has = F.col("yhat"), F.col("model_lower").isNotNull() & F.col("model_upper").isNotNull()
    lo, hi, lo95, hi95 = [c for c in bounds("yhat", "sd")]
    wide = lambda f: y * f
    return df.select(
        KEY, "date", "yhat",
        F.when(has, F.least("model_lower", wide(0.85))).otherwise(lo).alias("yhat_lower"),
        F.when(has, F.greatest("model_upper", wide(1.15))).otherwise(hi).alias("yhat_upper"),
        F.when(has, F.least("model_lower", wide(0.75))).otherwise(lo95).alias("yhat_lower_95"),
        F.when(has, F.greatest("model_upper", wide(1.25))).otherwise(hi95).alias("yhat_upper_95"),
    )


def residual_table(hist: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """Actual, predicted and residual per week; without a fit the 4-row partial mean stands in."""
    if fitted is None:
        df = hist.withColumn("predicted", F.avg("sales_qty").over(ordered().rowsBetween(-3, 0)))
    else:
        df = hist.join(fitted.select(KEY, TIME, F.col("fitted").alias("predicted")), [KEY, TIME])
    return df.select(KEY, TIME, F.col("sales_qty").alias("actual"), "predicted", (F.col("sales_qty") - F.col("predicted")).alias("residual"))


# ---- blending and scoring


def ensemble_weights(rmse: DataFrame, base: dict[str, float] | None = None) -> DataFrame:
    """0.6 x inverse-RMSE share + 0.4 x base per product, renormalised; base alone when no RMSE is usable.

    `rmse` holds (product_name, model, rmse); a null or infinite RMSE marks a missing model.
    """
    prior = F.lit(0.0)
    for m, w in (base or BASE_WEIGHTS).items():
        prior = F.when(F.col("model") == m, w).otherwise(prior)
    r = F.col("rmse")
    finite = r.isNotNull() & ~F.isnan(r) & (F.abs(r) != float("inf"))
    df = rmse.withColumns({"base": prior, "usable": F.coalesce(finite, F.lit(False))})
    df = df.withColumn("inv", F.when(F.col("usable") & (r > 0), 1 / (r + EPS)).otherwise(0.0))
    total = F.sum("inv").over(by())
    raw = F.when(total > 0, 0.6 * F.try_divide(F.col("inv"), total) + 0.4 * F.col("base"))
    df = df.withColumn("raw", raw.otherwise(F.when(F.col("usable"), F.col("base")).otherwise(0.0)))
    s = F.sum("raw").over(by())
    return df.select(KEY, "model", "rmse", F.when(s > 0, F.col("raw") / s).otherwise(F.col("raw")).alias("weight"))


def ensemble_blend(preds: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean over the models that have a value, not below 0."""
    df = preds.join(weights.select(KEY, "model", "weight"), [KEY, "model"])
    use = F.when(F.col("yhat").isNotNull() & (F.col("weight") > 0), F.col("weight"))
    out = df.groupBy(KEY, TIME).agg(
        F.sum(use * F.col("yhat")).alias("s"), F.sum(use).alias("w"), F.avg("yhat").alias("plain"), F.count("yhat").alias("models")
    )
    blend = F.coalesce(F.try_divide(F.col("s"), F.col("w")), F.col("plain"), F.lit(0.0))
    return out.select(KEY, TIME, F.greatest(F.lit(0.0), blend).alias("yhat"), "models")


def metrics(actual_pred: DataFrame, keys=(KEY, "model")) -> DataFrame:
    """RMSE, MAE, MSE, MAPE over non-zero actuals, both sMAPE forms and R2 per group in one pass."""
    y, f = F.col("actual"), F.col("predicted")
    inf = float("inf")
    ok = y.isNotNull() & f.isNotNull() & ~F.isnan(y) & ~F.isnan(f) & (F.abs(y) != inf) & (F.abs(f) != inf)
    e = F.abs(y - f)
    half = (F.abs(y) + F.abs(f)) / 2
    out = actual_pred.filter(ok).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((y - f) * (y - f)).alias("mse"),
        F.avg(e).alias("mae"),
        (F.avg(F.when(y != 0, e / F.abs(F.nullif(y, F.lit(0.0))))) * 100).alias("mape"),
        (F.avg(F.when(half == 0, 0.0).otherwise(e / F.nullif(half, F.lit(0.0)))) * 100).alias("smape"),
        (F.avg(2 * e / (F.abs(y) + F.abs(f) + 1e-8)) * 100).alias("smape_eps"),
        F.var_pop("actual").alias("var"),
    )
    return out.withColumns({"rmse": F.sqrt("mse"), "r2": 1 - F.try_divide(F.col("mse"), F.col("var"))}).drop("var")


def baseline_predictions(panel: DataFrame) -> DataFrame:
    """Last week, mean of the last 4 weeks and the fitted line as long (product, week, model) rows."""
    fit = trend_fit(panel, False)
    rows = panel.select(KEY, TIME, "sales_qty").join(fit, KEY)
    rows = rows.withColumns(
        {"naive": F.lag("sales_qty").over(ordered()), "mean4": F.avg("sales_qty").over(ordered().rowsBetween(-4, -1)),
         "trend": trend_value(TIME, False), "actual": F.col("sales_qty")}
    )
    return stacked(rows, "model", "predicted", [(m, F.col(m)) for m in ("naive", "mean4", "trend")], keep=[KEY, TIME, "actual"])


def model_leaderboard(scores: DataFrame) -> DataFrame:
    """Models of each product by RMSE, the lead over the next one and errors scaled by the worst."""
    w = by().orderBy("rmse", "model")
    df = scores.withColumns({"rank": F.row_number().over(w), "next_rmse": F.lead("rmse").over(w)})
    lead = (F.col("next_rmse") - F.col("rmse")) / (F.col("next_rmse") + EPS) * 100
    scaled = {f"{c}_score": F.when(F.max(c).over(by()) > 0, 100 - F.col(c) / F.max(c).over(by()) * 100) for c in ("rmse", "mae", "mse", "mape")}
    return df.withColumns({"improvement_pct": F.when(F.col("rank") == 1, F.coalesce(lead, F.lit(0.0))), **scaled})


def model_insight(scores: DataFrame, anoms: DataFrame) -> DataFrame:
    """Best model by sMAPE with its accuracy class and the number of anomalies per product."""
    best = scores.groupBy(KEY).agg(F.min_by("model", F.struct("smape", "model")).alias("best_model"), F.min("smape").alias("best_smape"))
    s = F.col("best_smape")
    best = best.withColumn("accuracy", F.when(s < 15, "EXCELLENT").when(s < 25, "GOOD").otherwise("WEAK"))
    counts = anoms.groupBy(KEY).agg(F.count(F.lit(1)).alias("anomalies"))
    return best.join(counts, KEY, "left").fillna({"anomalies": 0})


def fold_rows(panel: DataFrame, folds: int = 5, horizon: int = 12) -> DataFrame:
    """Expanding-window folds: each row once per fold as train or test (fewer folds for short series)."""
    n = F.count(F.lit(1)).over(by())
    rows = panel.select(KEY, TIME, "sales_qty").withColumns({"n": n, "rn": F.row_number().over(ordered())})
    short = F.col("n") < folds * horizon + 20
    k = F.when(short, F.greatest(F.lit(2), F.floor(F.col("n") / (horizon + 10)))).otherwise(folds).cast("int")
    rows = rows.withColumn("k", k).withColumn("size", F.floor(F.col("n") / (F.col("k") + 1)).cast("int")).filter("size > 0")
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.col("k"))))
    cut = F.col("n") - (F.col("k") - F.col("fold") + 1) * F.col("size")
    rows = rows.withColumn("cut", cut).filter(F.col("rn") <= F.col("cut") + F.col("size"))
    return rows.withColumn("role", F.when(F.col("rn") <= F.col("cut"), "train").otherwise("test"))


def cross_validation(panel: DataFrame, folds: int = 5, horizon: int = 12) -> DataFrame:
    """Mean and population deviation over the folds of each baseline's errors, per product and model."""
    rows = fold_rows(panel, folds, horizon)
    train = rows.filter("role = 'train'").groupBy(KEY, "fold").agg(
        F.avg("sales_qty").alias("mean"), F.max_by("sales_qty", "rn").alias("last"),
        F.regr_slope("sales_qty", "rn").alias("slope"), F.regr_intercept("sales_qty", "rn").alias("base"),
    )
    test = rows.filter("role = 'test'").join(train, [KEY, "fold"])
    line = F.greatest(F.lit(0.0), F.col("base") + F.col("slope") * F.col("rn"))
    test = test.withColumns({"trend": F.coalesce(line, F.col("mean")), "actual": F.col("sales_qty")})
    test = test.withColumn("blend", 0.4 * F.col("trend") + 0.3 * F.col("mean") + 0.3 * F.col("last"))
    long = stacked(test, "model", "predicted", [(m, F.col(m)) for m in ("mean", "last", "trend", "blend")], keep=[KEY, "fold", "actual"])
    return fold_summary(metrics(long, (KEY, "fold", "model")))


def fold_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.groupBy(KEY, "model").agg(
        F.count(F.lit(1)).alias("folds"),
        *[g.alias(f"{n}_{m}") for m in ("rmse", "mae", "mape", "r2") for n, g in (("avg", F.avg(m)), ("std", F.stddev_pop(m)))],
    )


# ---- figures on a forecast


def near(fc: DataFrame, k: int, agg=F.sum) -> Column:
    return agg(F.when(F.col("step") <= k, F.col("yhat")))


def peaks(fc: DataFrame) -> DataFrame:
    """Mean forecast by month: peak and low month, their values and the mean of the monthly means."""
    m = fc.groupBy(KEY, F.month("date").alias("m")).agg(F.avg("yhat").alias("v"))
    return m.groupBy(KEY).agg(
        F.min_by("m", F.struct(-F.col("v"), "m")).alias("peak_month"), F.min_by("m", F.struct("v", "m")).alias("low_month"),
        F.max("v").alias("peak_value"), F.avg("v").alias("month_mean"),
    )


def forecast_kpis(hist: DataFrame, fc: DataFrame, stock: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """Growth, next month and quarter, peak month, stock-out risk and confidence per product."""
    recent = last_n_mean(hist, 4)
    f = fc.groupBy(KEY).agg(
        near(fc, 4, F.avg).alias("next_mean"), near(fc, 4).alias("next_month"), near(fc, 13).alias("next_quarter"),
        F.count(F.lit(1)).alias("horizon"),
    )
    out = f.join(recent, KEY).join(peaks(fc).select(KEY, "peak_month", "low_month"), KEY)
    out = out.join(stock.select(KEY, F.col("stock_on_hand").alias("stock")), KEY, "left")
    growth = (F.col("next_mean") - F.col("mean_last_4")) / (F.col("mean_last_4") + EPS) * 100
    cover = F.col("stock") / (F.col("next_month") / 4 + EPS)
    out = out.withColumns(
        {
            "growth_pct": growth,
            "stockout_risk": F.when(F.col("stock") > 0, clip_col((1 - cover / 4) * 100, 0.0, 100.0)),
            "peak": month_name("peak_month"), "low": month_name("low_month"),
        }
    )
    if scores is not None:
        out = out.join(scores.select(KEY, "mape"), KEY, "left").withColumn("confidence", clip_col(100 - F.col("mape"), 0.0, 100.0))
    return out


def forecast_daily(weekly: DataFrame, daily: DataFrame, days: int = 30) -> DataFrame:
    """The first days of a weekly forecast: each week is spread over its days by the product's share of sales on that weekday.

    Weekdays on which a product never sold have no row; products without sales have none at all.
    """
    sold = daily.groupBy(KEY, F.weekday("date").alias("weekday")).agg(F.sum("sales_qty").alias("qty"))
    share = sold.withColumn("share", F.try_divide(F.col("qty"), F.sum("qty").over(by()))).select(KEY, "weekday", "share")  # seven rows of a product
    out = weekly.filter((F.col("step") - 1) * 7 < days).join(share.where(F.col("share").isNotNull()), KEY)
    out = out.select(KEY, ((F.col("step") - 1) * 7 + F.col("weekday") + 1).alias("step"), F.date_add("date", F.col("weekday")).alias("date"),
                     (F.col("yhat") * F.col("share")).alias("yhat"))
    return out.filter(F.col("step") <= days)


def forecast_kpis_daily(hist: DataFrame, fc: DataFrame) -> DataFrame:
    """Next 7 days, stock-out risk against the mean stock of the last 4 days, best and worst day."""
    recent = last_n_mean(hist.withColumnRenamed("date", TIME), 4, "stock_on_hand").withColumnRenamed("mean_last_4", "avg_stock")
    f = fc.groupBy(KEY).agg(
        F.sum(F.when(F.col("step") <= 7, F.greatest(F.lit(0.0), F.col("yhat")))).alias("next_week_sales"),
        near(fc, 7, F.avg).alias("avg_fc"),
        F.min_by("date", F.struct(-F.col("yhat"), "date")).alias("best_day"), F.max("yhat").alias("best_day_sales"),
        F.min_by("date", F.struct("yhat", "date")).alias("worst_day"), F.min("yhat").alias("worst_day_sales"),
    )
    out = f.join(recent, KEY, "left")
    s = F.col("avg_stock")
    gap = clip_col((F.col("avg_fc") - s) / F.greatest(s, F.lit(1.0)), 0.0, 1.0)
    return out.withColumn("stockout_risk", F.when(s > 0, gap))


def topk_weeks(fc: DataFrame, hist: DataFrame, k: int = 5) -> DataFrame:
    """The k largest forecast weeks per product with interval width, growth and confidence."""
    rank = F.row_number().over(by().orderBy(F.col("yhat").desc(), "date"))
    top = fc.withColumn("rank", rank).filter(F.col("rank") <= k).join(last_n_mean(hist, 4), KEY, "left")
    base, width = F.col("mean_last_4"), F.col("yhat_upper") - F.col("yhat_lower")
    growth = F.coalesce((F.col("yhat") - base) / (base + EPS) * 100, F.lit(0.0))
    return top.withColumns(
        {"ci_range": width, "growth_pct": growth, "confidence_pct": clip_col(100 - width / (F.col("yhat") + EPS) * 100, 0.0, 100.0)}
    )


def forecast_narrative(hist: DataFrame, fc: DataFrame, scores: DataFrame, elasticity: DataFrame, stock: DataFrame) -> DataFrame:
    """Trend, peak, quarter, stock, price and accuracy classes with the recommendations they lead to."""
    k = forecast_kpis(hist, fc, stock, scores)
    past = hist.withColumn("age", F.row_number().over(newest_first())).groupBy(KEY).agg(
        F.sum(F.when(F.col("age") <= 13, F.col("sales_qty"))).alias("last_quarter"), F.count(F.lit(1)).alias("history")
    )
    out = k.join(past, KEY).join(elasticity.select(KEY, "elasticity"), KEY, "left")
    last, nxt, h = F.col("mean_last_4"), F.col("next_mean"), F.col("horizon")
    change = (nxt - last) / last * 100
    e, risk, mape = F.col("elasticity"), F.col("stockout_risk"), F.col("mape")
    growth = (F.col("next_quarter") - F.col("last_quarter")) / (F.col("last_quarter") + EPS) * 100
    tips = F.array_compact(
        F.array(
            F.when(risk > 40, "Reorder inventory"),
            F.when(h >= 52, F.concat(F.lit("Plan promotions for "), F.col("peak"))),
            F.when(e < -1, "Consider price reduction"),
            F.lit("Update the model monthly"),
        )
    )
    return out.withColumns(
        {
            "trend": F.when(nxt > last * 1.1, "rise").when(nxt < last * 0.9, "decline").otherwise("stable"),
            "trend_pct": change,
            "season": F.when(h >= 52, F.concat_ws(" / ", "peak", "low")).when(h >= 13, F.col("peak")).otherwise("emerging"),
            "quarter_growth": F.when((h >= 13) & (F.col("history") >= 13), growth),
            "risk": F.when(risk > 70, "high").when(risk > 40, "moderate").when(risk.isNotNull(), "low").otherwise("unknown"),
            "price": F.when(e < -1, "elastic").when(e > -0.5, "inelastic").when(e.isNotNull(), "moderate").otherwise("unknown"),
            "accuracy": F.when(mape < 10, "excellent").when(mape < 20, "good").otherwise("moderate"),
            "recommendations": F.array_join(tips, "; "),
        }
    )


def insight_cards(fc: DataFrame, scores: DataFrame) -> DataFrame:
    """Peak month growth, the top week and the savings of an accurate model per product."""
    f = fc.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("horizon"), near(fc, 13).alias("next_quarter"), F.max("yhat").alias("top_value"),
        F.min_by("date", F.struct(-F.col("yhat"), "date")).alias("top_date"),
    )
    out = f.join(peaks(fc), KEY).join(scores.select(KEY, "mape"), KEY, "left")
    growth = (F.col("peak_value") - F.col("month_mean")) / (F.col("month_mean") + EPS) * 100
    return out.select(
        KEY, F.when(F.col("horizon") >= 52, month_name("peak_month")).alias("growth_month"),
        F.when(F.col("horizon") >= 52, growth).alias("growth_pct"), "top_date", "top_value",
        F.when(F.col("mape") < 15, F.col("next_quarter") * 0.05).alias("savings"), (100 - F.col("mape")).alias("confidence"),
    )


def exec_summary(anoms: DataFrame, alerts: DataFrame, pricing: DataFrame) -> DataFrame:
    """Counts of anomalies, urgent alerts and pricing rows, and the total gain."""
    a = anoms.agg(F.count(F.lit(1)).alias("anomalies"))
    b = alerts.agg(F.count_if(F.col("urgency") == "CRITICAL").alias("low_stock"))
    c = pricing.agg(F.count(F.lit(1)).alias("pricing_rows"), F.sum("revenue_gain").alias("total_gain"))
    out = with_scalars(with_scalars(a, b), c)
    return out.withColumn("top_actions", F.least(F.lit(5), F.col("pricing_rows")))


# ---- scenarios

SCENARIO = ["scenario", "price_delta", "promotion", "holiday", "intensity", "weather", "stock_factor"]


def scenario_multipliers(fc: DataFrame, scenarios: list[tuple], elasticity: float = -1.2) -> DataFrame:
    """Forecast and bounds under price, promotion, holiday, weather and stock assumptions.

    Scenarios: (name, price change %, promotion, holiday, intensity, weather, stock factor).
    """
    df = each(fc, SCENARIO, scenarios)
    promo = F.col("promotion") & (F.col("intensity") > 0)
    factor = F.pow(1 + F.col("price_delta") / 100, F.lit(elasticity)) if elasticity else F.lit(1.0)
    factor = factor * F.when(promo, PROMO).otherwise(1.0) * F.when(F.col("holiday"), HOLIDAY).otherwise(1.0)
    factor = factor * F.when(promo, 1 + F.col("intensity") * INTENSITY).otherwise(1.0)
    weather = F.lit(1.0)
    for name, m in WEATHER.items():
        weather = F.when(F.col("weather") == name, m).otherwise(weather)
    factor = factor * weather * F.least(F.lit(1.0), F.col("stock_factor"))
    df = df.withColumn("factor", factor)
    return df.withColumns({f"{c}_simulated": F.col(c) * F.col("factor") for c in ("yhat", "yhat_lower", "yhat_upper")})


def scenario_impact(sim: DataFrame, price: float = 100.0) -> DataFrame:
    """Change of the first four weeks' demand and revenue per product and scenario."""
    first = sim.filter("step <= 4").groupBy(KEY, "scenario", "price_delta").agg(
        F.sum("yhat").alias("base"), F.sum("yhat_simulated").alias("simulated")
    )
    out = first.withColumns(
        {
            "demand_change_pct": (F.col("simulated") - F.col("base")) / (F.col("base") + EPS) * 100,
            "base_revenue": F.col("base") * price,
            "simulated_revenue": F.col("simulated") * price * (1 + F.col("price_delta") / 100),
        }
    )
    d = F.col("demand_change_pct")
    return out.withColumns(
        {
            "revenue_change": F.col("simulated_revenue") - F.col("base_revenue"),
            "impact": F.when(d > 5, "Positive").when(d < -5, "Negative").otherwise("Neutral"),
        }
    )


def scenario_growth(fc: DataFrame, scenarios: list[tuple] | None = None) -> DataFrame:
    """Named scenarios: yearly growth by week and a factor in November to January; bounds keep their ratio."""
    df = each(fc, ["scenario", "growth", "seasonality"], scenarios or GROWTH_SCENARIOS)
    grow = F.pow(1 + F.col("growth"), (F.col("step") - 1) / 52.0)
    factor = grow * F.when(F.month("date").isin(11, 12, 1), F.col("seasonality")).otherwise(1.0)
    cols = ["yhat", "yhat_lower", "yhat_upper", "yhat_lower_95", "yhat_upper_95"]
    df = df.withColumn("factor", factor)
    return df.select(KEY, "scenario", "step", "date", *[(F.col(c) * F.col("factor")).alias(c) for c in cols])
