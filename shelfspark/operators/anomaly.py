"""Anomaly rules over the weekly panel and reports on what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY, TIME, by, rows, with_scalars
from shelfspark.functions.stats import corr, quantile_row
from shelfspark.operators.aggregates import join_first_match, sort_abs
from shelfspark.operators.cleaning import carried, carried_back
from shelfspark.operators.windows import full, tail_per_group

EPS = 1e-6
# Report texts.
ACTIONS = {
    "URGENT": "Urgent: review pricing and supply chain",
    "DROP": "Check supply, stock levels and promotional pricing",
    "SPIKE": "Raise stock, use the surge, review pricing",
    "NONE": "Monitor closely",
}
LOW_ACTIONS = "Promote to lift demand; Review supply for bottlenecks; Check competitor prices"
HIGH_ACTIONS = "Raise stock; Target the extra demand; Review supply capacity"
CALM_ACTIONS = "Monitor trends; Look for causes; Review past patterns"


def _expected(width_max: int = 8) -> Column:
    """Centred mean of width min(8, n // 2); products have n >= 10."""
    n = F.col("n")
    mean = F.lit(None).cast("double")
    for k in range(5, width_max + 1):
        w = rows(-(k // 2), (k - 1) // 2)
        here = F.when(F.count("sales_qty").over(w) == k, F.avg("sales_qty").over(w))
        mean = F.when(F.least(F.lit(width_max), F.floor(n / 2)) == k, here).otherwise(mean)
    return mean


def scored(panel: DataFrame, iso: DataFrame | None = None, resid: DataFrame | None = None) -> DataFrame:
    """Every row of products with 10 or more weeks with its expected value, flags and deviation.

    `iso` and `resid` are optional (product, week, flag) tables of the isolation and
    residual detectors. Scores are counted in tenths to keep comparisons exact.
    """
    p = by()
    out = panel.withColumns(
        {
            "n": F.count(F.lit(1)).over(p), "mean": F.avg("sales_qty").over(p), "std": F.stddev_samp("sales_qty").over(p),
            "q": F.percentile("sales_qty", F.array(F.lit(0.25), F.lit(0.75))).over(p),
        }
    ).filter("n >= 10")
    out = out.withColumn("raw", _expected())
    out = out.withColumn("expected_sales", F.coalesce(carried("raw"), carried_back("raw")))
    cv = F.col("std") / (F.col("mean") + EPS)
    cut = F.when(cv < 0.3, 2.5).when(cv < 0.5, 2.0).otherwise(1.5)
    z = (F.col("sales_qty") - F.col("mean")) / (F.col("std") + EPS)
    lo, hi = F.col("q")[0], F.col("q")[1]
    outside = (F.col("sales_qty") < lo - 1.5 * (hi - lo)) | (F.col("sales_qty") > hi + 1.5 * (hi - lo))
    out = out.withColumns({"z_flag": (F.abs(z) > cut).cast("int"), "iqr_flag": outside.cast("int")})
    for name, flags in (("iso_flag", iso), ("resid_flag", resid)):
        if flags is None:
            out = out.withColumn(name, F.lit(0))
        else:
            out = out.join(flags.select(KEY, TIME, F.col("flag").alias(name)), [KEY, TIME], "left").fillna({name: 0})
    tenths = 3 * F.col("z_flag") + 3 * F.col("iqr_flag") + 3 * F.col("iso_flag") + F.col("resid_flag")
    deviation = (F.col("sales_qty") - F.col("expected_sales")) / (F.col("expected_sales") + EPS) * 100
    return out.withColumns({"score_tenths": tenths, "deviation_pct": deviation}).drop("raw", "q")


def anomaly_hybrid(panel: DataFrame, iso: DataFrame | None = None, resid: DataFrame | None = None) -> DataFrame:
    """Rows where detectors worth half of the score agree, with severity, confidence and action."""
    rows_ = scored(panel, iso, resid).filter("score_tenths >= 5")
    d = F.abs("deviation_pct")
    severity = F.when(d > 50, "Severe").when(d > 25, "Moderate").when(d > 10, "Mild").otherwise("Normal")
    action = (
        F.when(d > 50, ACTIONS["URGENT"]).when(F.col("deviation_pct") > 30, ACTIONS["SPIKE"])
        .when(F.col("deviation_pct") < -30, ACTIONS["DROP"]).otherwise(ACTIONS["NONE"])
    )
    return rows_.select(
        KEY, F.col(TIME).alias("date"), F.col("sales_qty").alias("actual_sales"), "expected_sales", "deviation_pct",
        severity.alias("severity"), action.alias("suggested_action"), (F.col("score_tenths") * 10.0).alias("confidence"),
    )


def _change(panel: DataFrame, normal: str, reason: Column, action: str) -> DataFrame:
    up = F.col("sales_qty") > F.col(normal)
    change = F.abs((F.col("sales_qty") - F.col(normal)) / F.col(normal) * 100)
    return panel.filter(F.col(normal) > 0).select(
        F.when(up, "SALES SPIKE").otherwise("SALES DROP").alias("type"), KEY, "category", F.col(TIME).alias("date"),
        F.col("sales_qty").alias("actual_sales"), F.col(normal).alias("normal_sales"), change.alias("change_pct"),
        reason.alias("possible_reason"), F.lit(action).alias("recommended_action"),
    )


def anomaly_rolling_2sigma(panel: DataFrame, width: int = 4, k: float = 2.0, last: int = 2) -> DataFrame:
    """Rows further than k rolling deviations from the rolling mean, the newest `last` per product.

    The windows include the row itself, so with 4 rows the distance never passes 1.5
    deviations; wider windows do fire.
    """
    out = panel.withColumns(
        {"n": F.count(F.lit(1)).over(by()), "ma": full(F.avg, "sales_qty", width), "sd": full(F.stddev_samp, "sales_qty", width)}
    )
    out = out.filter((F.col("n") >= 8) & (F.abs(F.col("sales_qty") - F.col("ma")) > k * F.col("sd")))
    return _change(tail_per_group(out, last), "ma", F.lit("Statistical anomaly detected"), "Review and investigate cause")


def anomaly_recent_flagged(panel: DataFrame, flags: DataFrame, weeks: int = 4) -> DataFrame:
    """Flagged rows (flag = -1) of the last weeks against the product's mean of unflagged rows."""
    rows_ = panel.join(flags.select(KEY, TIME, "flag"), [KEY, TIME])
    rows_ = rows_.withColumn("normal", F.avg(F.when(F.col("flag") == 1, F.col("sales_qty"))).over(by()))
    since = panel.agg(F.date_sub(F.max(TIME), 7 * weeks).alias("d")).scalar()
    recent = rows_.filter((F.col("flag") == -1) & (F.col(TIME) >= since))
    reason = F.when(F.col("sales_qty") > F.col("normal"), "Promotion/Market factors").otherwise("Competition/Quality issue")
    return _change(recent, "normal", reason, "Investigate and adjust inventory planning")


def anomaly_listing(panel: DataFrame, flags: DataFrame) -> DataFrame:
    flagged = flags.filter("flag = -1").select(KEY, TIME)
    return panel.join(flagged, [KEY, TIME], "left_semi").select(
        KEY, "category", TIME, "sales_qty", F.lit("Investigate anomaly").alias("action")
    )


def residual_flags(fitted: DataFrame, z: float = 3.0, population: bool = False) -> DataFrame:
    """Rows whose residual (sales_qty - fitted) is z deviations from its mean.

    With `population` the residual itself is compared with the population deviation.
    """
    resid = F.col("sales_qty") - F.col("fitted")
    out = fitted.filter("fitted IS NOT NULL AND sales_qty IS NOT NULL").withColumn("resid", resid)
    if population:
        out = out.withColumn("z", F.try_divide(F.col("resid"), F.stddev_pop("resid").over(by())))
        return out.filter(F.abs("z") > z)
    sd = F.stddev_samp("resid").over(by())
    sd = F.when(sd > 0, sd).otherwise(1.0)
    return out.withColumn("z", (F.col("resid") - F.avg("resid").over(by())) / sd).filter(F.abs("z") >= z)


def forecast_high_flags(fc: DataFrame) -> DataFrame:
    """Forecast weeks above mean + 2 sample deviations of the product's forecast."""
    p = by()
    out = fc.withColumn("limit", F.avg("yhat").over(p) + 2 * F.stddev_samp("yhat").over(p))
    out = out.withColumn("n", F.count(F.lit(1)).over(p)).filter((F.col("n") >= 4) & (F.col("yhat") > F.col("limit")))
    return out.select(KEY, "date", F.col("yhat").alias("value"), F.lit("high_forecast").alias("type"), F.lit("moderate").alias("severity"))


def anomaly_sensitivity(anoms: DataFrame, s: float = 50, mild: bool = False) -> DataFrame:
    """Anomalies at or above (100 - s) % of the product's 95th percentile of absolute deviation."""
    cut = (100 - s) / 100 * F.percentile(F.abs("deviation_pct"), F.lit(0.95)).over(by())
    out = anoms.withColumn("cut", cut).filter(F.abs("deviation_pct") >= F.col("cut")).drop("cut")
    return out if mild else out.filter(F.col("severity").isin("Moderate", "Severe"))


def anomaly_one_class(df: DataFrame, cols: list[str], nu: float = 0.05) -> DataFrame:
    """The nu share of rows furthest from the centre by Mahalanobis distance on two columns.

    For more columns pass the two component scores of `scale_pca`.
    """
    a, b = cols
    m = df.agg(
        F.avg(a).alias("__ma"), F.avg(b).alias("__mb"), F.stddev_samp(a).alias("__sa"), F.stddev_samp(b).alias("__sb"),
        corr(a, b).alias("__r"),
    )
    out = with_scalars(df, m)
    za, zb = (F.col(a) - F.col("__ma")) / F.col("__sa"), (F.col(b) - F.col("__mb")) / F.col("__sb")
    r = F.col("__r")
    out = out.withColumn("distance", (za * za - 2 * r * za * zb + zb * zb) / (1 - r * r))
    out = out.drop("__ma", "__mb", "__sa", "__sb", "__r")
    out = with_scalars(out, quantile_row(out, {"__cut": ("distance", 1 - nu)}))
    return out.withColumn("flag", F.when(F.col("distance") > F.col("__cut"), -1).otherwise(1)).drop("__cut")


def anomaly_root_cause(anoms: DataFrame, panel: DataFrame) -> DataFrame:
    """Likely causes, pattern and actions from the anomaly's own week."""
    df = join_first_match(anoms, panel)
    d = F.col("deviation_pct")
    causes = F.array_compact(
        F.array(
            F.when(F.col("price").isNotNull() & (d < -20), "increased pricing")
            .when(F.col("price").isNotNull() & (d > 20), "price reduction or promotion"),
            F.when(F.col("stock_on_hand") < 50, "low inventory levels"),
            F.when(F.col("promotion") > 0, "active promotion campaign"),
            F.when(F.col("holiday_flag") > 0, "holiday period effect"),
        )
    )
    fallback = F.array(F.lit("seasonal variation"), F.lit("market demand shift"), F.lit("external factors"))
    df = df.withColumn("causes", F.when(F.size(causes) > 0, causes).otherwise(fallback))
    text = F.array_join("causes", ", ")
    pattern = (
        F.when(text.contains("holiday"), "spike before holidays").when(d < -20, "consistent weekly drops")
        .when(text.contains("promotion"), "promotional spikes").otherwise("significant sales variation")
    )
    strength = (
        F.when(d > 50, "major sales spike").when(d < -50, "severe sales drop").when(d > 25, "significant surge")
        .when(d < -25, "notable decline")
    )
    return df.withColumns(
        {
            "likely_causes": text,
            "cause_text": F.array_join(F.slice("causes", 1, 2), " and "),
            "pattern_type": pattern,
            "pattern": strength,
            "direction": F.when(d > 0, "surge").otherwise("drop"),
            "actions": F.when(d < -30, LOW_ACTIONS).when(d > 30, HIGH_ACTIONS).otherwise(CALM_ACTIONS),
        }
    ).drop("causes")


def anomaly_feed(anoms: DataFrame, n: int = 6) -> DataFrame:
    d = F.col("deviation_pct")
    message = (
        F.when(d > 30, "spike due to promotional activity or demand surge")
        .when(d < -30, "drop likely due to supply constraints or pricing changes").otherwise("variation to monitor")
    )
    return sort_abs(anoms, "deviation_pct", n, KEY, "date").withColumn("message", message)


def anomaly_stats(anoms: DataFrame) -> DataFrame:
    """Deviation figures, severe count, busiest month and confidence per product."""
    d = F.abs("deviation_pct")
    return anoms.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(d).alias("avg_deviation"),
        F.median(d).alias("median_deviation"),
        F.stddev_samp("deviation_pct").alias("std_deviation"),
        F.count_if(F.col("severity") == "Severe").alias("severe"),
        F.mode(F.month("date"), True).alias("top_month"),
        F.avg("confidence").alias("avg_confidence"),
    )


def anomaly_sign_pattern(anoms: DataFrame) -> DataFrame:
    out = anoms.groupBy(KEY).agg(
        F.count_if(F.col("deviation_pct") > 0).alias("spikes"), F.count_if(F.col("deviation_pct") < 0).alias("drops")
    )
    up, down = F.col("spikes"), F.col("drops")
    kind = F.when(up > down * 2, "Consistent spikes").when(down > up * 2, "Consistent drops").otherwise("Mixed variations")
    return out.withColumn("pattern", kind)


def anomaly_report(anoms: DataFrame, n: int = 5) -> DataFrame:
    """One summary row and the n largest deviations per product, told apart by `line`."""
    stats = anomaly_stats(anoms).select(
        KEY, F.lit(0).alias("line"), F.col("n").alias("anomalies"), F.col("avg_deviation").alias("deviation"),
        "severe", F.col("avg_confidence").alias("confidence"), F.lit(None).cast("date").alias("date"),
        F.lit(None).cast("string").alias("severity"),
    )
    rank = F.row_number().over(by().orderBy(F.abs("deviation_pct").desc(), "date"))
    top = anoms.withColumn("line", rank).filter(F.col("line") <= n).select(
        KEY, "line", F.lit(None).cast("bigint").alias("anomalies"), F.col("deviation_pct").alias("deviation"),
        F.lit(None).cast("bigint").alias("severe"), "confidence", "date", "severity",
    )
    return stats.unionByName(top)


