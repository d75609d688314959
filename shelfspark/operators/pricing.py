"""Price elasticity, price grids and price recommendations per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY, TIME, by, each, pct, safe_divide
from shelfspark.functions.stats import corr
from shelfspark.operators.aggregates import month_means
from shelfspark.operators.windows import change

# Fallback elasticities and the minimum history of each estimator.
GATED_DEFAULT = -1.2
RIDGE_DEFAULT = -1.5
MIN_WEEKS, MIN_PRICES, MIN_KEPT, RIDGE_MIN = 12, 3, 5, 8
EPS = 1e-6


def _log(c: str) -> Column:
    return F.ln(F.col(c) + EPS)


def elasticity_gated(panel: DataFrame) -> DataFrame:
    """Log-log slope over weeks whose price moved by 1-100 % and quantity by under 200 %."""
    steps = panel.select(KEY, "price", "sales_qty", change("price").alias("dp"), change("sales_qty").alias("dq"))
    kept = (F.abs("dp") > 0.01) & (F.abs("dp") < 1) & (F.abs("dq") < 2)
    out = steps.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("price").alias("prices"),
        F.count_if(kept).alias("kept"),
        F.regr_slope(F.when(kept, _log("sales_qty")), F.when(kept, _log("price"))).alias("slope"),
    )
    few = (F.col("n") < MIN_WEEKS) | (F.col("prices") < MIN_PRICES) | (F.col("kept") < MIN_KEPT)
    return out.withColumn("elasticity", F.when(few, GATED_DEFAULT).otherwise(F.coalesce("slope", F.lit(GATED_DEFAULT))))


def elasticity_simple(panel: DataFrame) -> DataFrame:
    """Log-log slope over all weeks with a price and a quantity."""
    rows = panel.dropna(subset=["price", "sales_qty"])
    out = rows.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("price").alias("prices"),
        F.regr_slope(_log("sales_qty"), _log("price")).alias("slope"),
    )
    few = (F.col("n") < MIN_WEEKS) | (F.col("prices") < MIN_PRICES)
    return out.withColumn("elasticity", F.when(few, GATED_DEFAULT).otherwise(F.coalesce("slope", F.lit(GATED_DEFAULT))))


def elasticity_ridge(panel: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Ridge slope on logs where its R2 exceeds 0.3, else the ratio of mean changes by price.

    The one-variable ridge has a closed form in the second moments, so it is one aggregate.
    """
    by_price = by().orderBy("price", TIME)
    prev_p, prev_q = F.lag("price").over(by_price), F.lag("sales_qty").over(by_price)
    rows = panel.select(
        KEY, "price", "sales_qty", (F.try_divide(F.col("price"), prev_p) - 1).alias("dp"),
        (F.try_divide(F.col("sales_qty"), prev_q) - 1).alias("dq"),
        _log("price").alias("x"), _log("sales_qty").alias("y"),
    )
    valid = (F.col("dp") != 0) & F.col("dq").isNotNull()
    m = rows.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(valid, F.col("dp"))).alias("mean_dp"),
        F.avg(F.when(valid, F.col("dq"))).alias("mean_dq"),
        (F.covar_pop("x", "y") * F.count("x")).alias("sxy"),
        (F.var_pop("x") * F.count("x")).alias("sxx"),
        (F.var_pop("y") * F.count("y")).alias("syy"),
    )
    simple = -safe_divide("mean_dq", "mean_dp", RIDGE_DEFAULT)
    simple = F.when(F.col("mean_dp").isNull(), RIDGE_DEFAULT).otherwise(simple)
    slope = F.col("sxy") / (F.col("sxx") + alpha)
    m = m.withColumns({"simple": simple, "slope": slope})
    lost = F.col("syy") - 2 * F.col("slope") * F.col("sxy") + F.col("slope") * F.col("slope") * F.col("sxx")
    m = m.withColumn("r2", 1 - F.try_divide(lost, F.col("syy")))
    few, good = F.col("n") < RIDGE_MIN, F.coalesce(F.col("r2") > 0.3, F.lit(False))
    m = m.select(
        KEY, F.col("n").alias("data_points"),
        F.when(few, RIDGE_DEFAULT).when(good, F.col("slope")).otherwise(F.col("simple")).alias("elasticity"),
        F.when(few, 0.0).when(good, F.col("r2")).otherwise(0.5).alias("r2_score"),
        F.when(few, "default").when(good, "log-log").otherwise("simple").alias("method"),
    )
    text = F.when(F.col("method") == "default", "Insufficient Data").otherwise(class_of("elasticity"))
    return m.withColumn("classification", text)


def class_of(e: str) -> Column:
    c = F.col(e)
    return F.when(c < -1, "Elastic").when(c < 0, "Inelastic").otherwise("Neutral")


def elasticity_class(elasticity: DataFrame) -> DataFrame:
    """Both class labels: the report's and the dashboard's."""
    e = F.col("elasticity")
    label = F.when(e < -1, "Elastic").when(e > -0.5, "Inelastic").otherwise("Unit-Elastic")
    return elasticity.withColumns({"classification": class_of("elasticity"), "label": label})


def price_base(panel: DataFrame) -> DataFrame:
    """Mean price and quantity, latest price and row count per product."""
    return panel.groupBy(KEY).agg(
        F.avg("price").alias("avg_price"),
        F.avg("sales_qty").alias("avg_qty"),
        F.max_by("price", TIME).alias("current_price"),
        F.count(F.lit(1)).alias("weeks"),
    )


def priced(panel: DataFrame, elasticity: DataFrame) -> DataFrame:
    """Price base with the product's elasticity: both sides are grouped by product already."""
    e = elasticity.select(KEY, "elasticity")
    return price_base(panel).join(e, KEY, "left").fillna({"elasticity": RIDGE_DEFAULT})


def pricing_opportunities(panel: DataFrame, elasticity: DataFrame) -> DataFrame:
    e = F.col("elasticity")
    out = priced(panel, elasticity).withColumn("change_pct", F.when(e < -1, -5.0).when(e > -0.5, 5.0).otherwise(0.0))
    share = F.col("change_pct") / 100
    advice = F.when(e < -1, "Consider price reduction").when(e > -0.5, "Price increase opportunity")
    out = out.withColumns(
        {
            "recommendation": advice.otherwise("Maintain current pricing"),
            "new_price": F.col("avg_price") * (1 + share),
            "new_qty": F.col("avg_qty") * (1 + e * F.col("change_pct") / 100),
            "current_revenue": F.col("avg_price") * F.col("avg_qty"),
        }
    )
    out = out.withColumn("projected_revenue", F.col("new_price") * F.col("new_qty"))
    out = out.withColumn("revenue_gain", F.col("projected_revenue") - F.col("current_revenue"))
    return out.orderBy(F.col("revenue_gain").desc(), KEY)


def price_sensitivity(panel: DataFrame) -> DataFrame:
    """Products whose price and quantity correlate in a way that suggests a price test."""
    out = panel.groupBy(KEY).agg(
        F.min_by("category", TIME).alias("category"),
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp("price").alias("price_std"),
        corr("price", "sales_qty").alias("corr"),
        F.max_by("price", TIME).alias("current_price"),
        F.avg("sales_qty").alias("avg_sales"),
    )
    c = F.col("corr")
    kind = F.when(c < -0.3, "PRICE SENSITIVE").when(c > 0.3, "PREMIUM OPPORTUNITY").when(F.abs(c) < 0.1, "PRICE INELASTIC")
    action = F.when(c < -0.3, "Test a 5-10% price reduction").when(c > 0.3, "Test a 5-15% price increase")
    out = out.filter("n >= 4 AND price_std > 0").withColumns(
        {
            "insight_type": kind,
            "suggested_action": action.otherwise("Work on cost instead of price"),
            "priority": F.col("avg_sales") * F.abs(c),
        }
    )
    return out.filter("insight_type IS NOT NULL")


def priority_rank(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("priority").desc(), KEY)


def markup_rule(prices: DataFrame, margin: float = 0.3, textbook: bool = False) -> DataFrame:
    """Cost-plus price from elasticity with a 10 % floor over cost (price, elasticity in)."""
    p, e = F.col("price"), F.col("elasticity")
    out = prices.withColumn("cost", p * (1 - margin))
    cost = F.col("cost")
    ideal = cost / (1 + 1 / e) if textbook else cost / (1 + 1 / F.abs(e))
    out = out.withColumn("optimal_price", F.greatest(cost * 1.1, F.when(e < -1, ideal).otherwise(p * 1.1)))
    best = F.col("optimal_price")
    out = out.withColumns({"price_change_pct": (best - p) / p * 100, "qty_change_pct": e * ((best - p) / p) * 100})
    new_profit = (best - cost) * (1 + F.col("qty_change_pct") / 100)
    out = out.withColumn("profit_gain", new_profit - (p - cost))
    gain = F.when(p > cost, F.col("profit_gain") / (p - cost) * 100).otherwise(0.0)
    return out.withColumn("profit_gain_pct", gain)


def price_zones(panel: DataFrame, elasticity: DataFrame) -> DataFrame:
    """Demand and revenue at the base, optimal, aggressive and premium price and the best zone."""
    out = priced(panel, elasticity)
    base, e = F.col("avg_price"), F.col("elasticity")
    prices = {
        "base": base,
        "opt": base * (1 + 0.1 * (1 / (1 + F.exp(-e)))),
        "aggressive": base * 0.95,
        "premium": base * 1.10,
    }
    out = out.withColumns({f"{z}_price": p for z, p in prices.items()})
    out = out.withColumns({f"{z}_demand": F.col("avg_qty") * F.pow(F.col(f"{z}_price") / base, e) for z in prices})
    out = out.withColumns({f"{z}_revenue": F.col(f"{z}_price") * F.col(f"{z}_demand") for z in prices})
    top = F.greatest(*[F.col(f"{z}_revenue") for z in prices])
    best = (
        F.when(F.col("opt_revenue") == top, "Optimal").when(F.col("aggressive_revenue") == top, "Aggressive")
        .when(F.col("premium_revenue") == top, "Premium").otherwise("Base")
    )
    gain = F.when(F.col("base_revenue") > 0, pct(top, "base_revenue")).otherwise(0.0)
    return out.withColumns({"optimal_zone": best, "revenue_gain_pct": gain})


def whatif_price(panel: DataFrame, elasticity: DataFrame, changes=(-10.0, -5.0, 5.0, 10.0)) -> DataFrame:
    """Demand and revenue per product under each price change in percent."""
    out = each(priced(panel, elasticity), ["change_pct"], [(float(c),) for c in changes])
    out = out.withColumn("new_price", F.col("avg_price") * (1 + F.col("change_pct") / 100))
    out = out.withColumn("new_demand", F.col("avg_qty") * F.pow(F.col("new_price") / F.col("avg_price"), "elasticity"))
    out = out.withColumns(
        {"current_revenue": F.col("avg_price") * F.col("avg_qty"), "new_revenue": F.col("new_price") * F.col("new_demand")}
    )
    out = out.withColumn("revenue_delta", F.col("new_revenue") - F.col("current_revenue"))
    return out.withColumns(
        {
            "revenue_delta_pct": safe_divide("revenue_delta", "current_revenue") * 100,
            "direction": F.when(F.col("revenue_delta") > 0, "raises revenue").otherwise("reduces revenue"),
            "price_elastic": F.abs("elasticity") > 1,
        }
    )


def cross_price_grid(prices: DataFrame, lo: float, hi: float, n: int, price: str = "price") -> DataFrame:
    """n evenly spaced candidate prices per row, from lo to hi times the row's price."""
    p = F.col(price)
    step = (p * hi - p * lo) / (n - 1)
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), (p * lo + i * step).alias("c")))
    out = prices.withColumn("__g", F.explode(grid))
    return out.select(*prices.columns, F.col("__g.i").alias("step"), F.col("__g.c").alias("candidate"))


def argmax_grid(grid: DataFrame, score: str, key: str = KEY) -> DataFrame:
    """The candidate with the highest score, the first on ties. Partial sums keep it shuffle-light."""
    rest = [c for c in grid.columns if c != key]
    best = grid.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(-F.col(score), "step")).alias("b"))
    return best.select(key, "b.*")


def _curve(df: DataFrame, cost: Column, lo: float, hi: float, n: int) -> DataFrame:
    out = cross_price_grid(df.withColumn("cost", cost), lo, hi, n, "current_price")
    return out.withColumn("change_pct", (F.col("candidate") - F.col("current_price")) / F.col("current_price") * 100)


def _earn(df: DataFrame, factor: Column) -> DataFrame:
    out = df.withColumn("qty", F.col("avg_qty") * F.greatest(F.lit(0.1), factor))
    return out.withColumns(
        {"revenue": F.col("candidate") * F.col("qty"), "profit": (F.col("candidate") - F.col("cost")) * F.col("qty")}
    )


def profit_curve_50(panel: DataFrame, elasticity: DataFrame, cost: float = 0.5) -> DataFrame:
    """Quantity, revenue and profit at 50 prices between 0.7 and 1.3 times the current price."""
    grid = _curve(priced(panel, elasticity), F.col("current_price") * cost, 0.7, 1.3, 50)
    return _earn(grid, 1 + F.col("elasticity") * F.col("change_pct") / 100)


def profit_scan_5(panel: DataFrame, elasticity: DataFrame) -> DataFrame:
    """Best of five price factors per product, cost taken as half of the tested price."""
    base = priced(panel, elasticity).filter(F.col("weeks") >= MIN_WEEKS)
    tested = each(base, ["step", "factor"], [(0, 0.9), (1, 0.95), (2, 1.0), (3, 1.05), (4, 1.1)])
    tested = tested.withColumn("tested_price", F.col("avg_price") * F.col("factor"))
    move = (F.col("tested_price") - F.col("avg_price")) / F.col("avg_price") * 100
    tested = tested.withColumn("demand", F.col("avg_qty") * (1 + F.col("elasticity") * move / 100))
    tested = tested.withColumn("profit", (F.col("tested_price") - F.col("tested_price") * 0.5) * F.col("demand"))
    best = argmax_grid(tested, "profit")
    keep = F.col("profit") > 0
    best = best.withColumn("recommended_price", F.when(keep, F.col("tested_price")).otherwise(F.col("avg_price")))
    move = (F.col("recommended_price") - F.col("avg_price")) / F.col("avg_price")
    revenue = F.col("recommended_price") * (F.col("avg_qty") * (1 + F.col("elasticity") * move * 100 / 100))
    now = F.col("avg_price") * F.col("avg_qty")
    return best.withColumn("revenue_change_pct", F.when(now > 0, (revenue - now) / now * 100).otherwise(0.0))


def profit_curve_competitor(
    panel: DataFrame, elasticity: DataFrame, margin: float = 0.3, surge: float = 0.0, impact: float = 10.0
) -> DataFrame:
    """Profit at 100 prices between 0.8 and 1.2 times the current price, alone and against a competitor."""
    base = priced(panel, elasticity).withColumn("competitor", F.col("current_price") * 0.95)
    grid = _curve(base, F.col("current_price") * (1 - margin), 0.8, 1.2, 100)
    own = _earn(grid, 1 + F.col("elasticity") * F.col("change_pct") / 100 + surge)
    share = impact / 100
    gap = F.abs((F.col("competitor") - F.col("current_price")) / F.col("current_price") * 100)
    adjusted = F.col("elasticity") + share * gap / 10
    pull = share * ((F.col("competitor") - F.col("candidate")) / F.col("current_price")) * 100
    factor = 1 + adjusted * F.col("change_pct") / 100 + pull / 100
    qty = F.col("avg_qty") * F.greatest(F.lit(0.1), factor)
    return own.withColumn("competitive_profit", (F.col("candidate") - F.col("cost")) * qty)


def elasticity_curve(panel: DataFrame, elasticity: DataFrame) -> DataFrame:
    """Demand and revenue at 50 prices around the mean price, the revenue peak and price bands."""
    grid = cross_price_grid(priced(panel, elasticity), 0.7, 1.3, 50, "avg_price")
    grid = grid.withColumn("demand", F.col("avg_qty") * F.pow(F.col("candidate") / F.col("avg_price"), "elasticity"))
    grid = grid.withColumn("revenue", F.col("candidate") * F.col("demand"))
    best = argmax_grid(grid, "revenue").select(KEY, F.col("candidate").alias("best_price"))
    out = grid.join(best, KEY)
    c, b = F.col("candidate"), F.col("best_price")
    return out.withColumn("band", F.when(c < b, "under-priced").when(c > b, "over-priced").otherwise("optimal"))


def pricing_profile(panel: DataFrame, elasticity: DataFrame, r2: float = 0.5) -> DataFrame:
    """Five scores from 0 to 1: seasonality, promotion, demand, margin, model fit."""
    season = month_means(panel).groupBy(KEY).agg(
        F.try_divide(F.stddev_samp("mean_qty"), F.avg("mean_qty")).alias("season_cv")
    )
    q = F.col("sales_qty")
    promo = panel.groupBy(KEY).agg(
        F.avg(F.when(F.col("promotion") == 1, q)).alias("on"), F.avg(F.when(F.col("promotion") == 0, q)).alias("off")
    )
    e = F.col("elasticity")
    out = promo.join(season, KEY, "left").join(elasticity.select(KEY, "elasticity"), KEY, "left")
    swing = F.abs(F.try_divide(F.col("on") - F.col("off"), (F.col("on") + F.col("off")) / 2))
    return out.select(
        KEY,
        F.least(F.lit(1.0), F.coalesce("season_cv", F.lit(0.5)) * 2).alias("seasonality"),
        F.least(F.lit(1.0), F.coalesce(swing, F.lit(0.3)) * 2).alias("promotions"),
        F.when(e < 0, F.least(F.lit(1.0), F.abs(e) / 2)).otherwise(0.5).alias("demand_sensitivity"),
        F.lit(min(1.0, 0.25 / 0.5)).alias("profit_margin"),
        F.lit(r2).alias("model_confidence"),
    )


def pricing_insights(panel: DataFrame, elasticity: DataFrame) -> DataFrame:
    """Class, advice and the revenue gain of a 3 % rise for inelastic products."""
    out = priced(panel, elasticity).withColumn("classification", class_of("elasticity"))
    kind = F.col("classification")
    advice = F.when(kind == "Elastic", "Keep prices competitive").when(kind == "Inelastic", "Prices can rise by up to 8%")
    now = F.col("avg_price") * F.col("avg_qty")
    later = (F.col("avg_price") * 1.03) * (F.col("avg_qty") * F.pow(F.lit(1.03), "elasticity"))
    sold = (F.col("avg_price") > 0) & (F.col("avg_qty") > 0) & (kind == "Inelastic")
    return out.withColumns(
        {"advice": advice.otherwise("Decide on position and stock"), "revenue_gain": F.when(sold, later - now)}
    )


def current_recommendations(panel: DataFrame, zones: DataFrame) -> DataFrame:
    """Latest price of each product against its optimal price."""
    latest = panel.groupBy(KEY).agg(F.max_by("price", TIME).alias("latest_price"))
    out = latest.join(zones.select(KEY, "opt_price", "opt_revenue", "optimal_zone"), KEY)
    return out.withColumn("price_change", F.col("opt_price") - F.col("latest_price"))


def recommendation_summary(recs: DataFrame) -> DataFrame:
    return recs.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(F.col("price_change") > 0).alias("increases"),
        F.count_if(F.col("price_change") < 0).alias("decreases"),
        F.sum("opt_revenue").alias("projected_revenue"),
    )


def revenue_impact(zones: DataFrame) -> DataFrame:
    gain = F.col("base_revenue") * (F.col("revenue_gain_pct") / 100)
    return zones.agg(F.sum(gain).alias("revenue_gain"), F.count(F.lit(1)).alias("products"))


def portfolio_elasticity(elasticity: DataFrame) -> DataFrame:
    out = elasticity.agg(F.avg("elasticity").alias("mean_elasticity"))
    e = F.col("mean_elasticity")
    return out.withColumn("note", F.when(e < -1, "price-elastic").when(e > -1, "price-inelastic").otherwise("mixed"))


def price_simulation_profit(
    panel: DataFrame, elasticity: DataFrame, change: float = 5.0, cost: float = 0.5, promo: float = 0.0
) -> DataFrame:
    """Demand, revenue and profit after one price change, with an optional promotion lift."""
    out = priced(panel, elasticity)
    p = F.col("current_price")
    out = out.withColumns(
        {"new_price": p * (1 + change / 100), "cost": p * cost, "demand_change_pct": F.col("elasticity") * change + promo * 10}
    )
    out = out.withColumn("new_qty", F.col("avg_qty") * (1 + F.col("demand_change_pct") / 100))
    out = out.withColumns(
        {
            "new_revenue": F.col("new_price") * F.col("new_qty"),
            "new_profit": (F.col("new_price") - F.col("cost")) * F.col("new_qty"),
            "current_profit": (p - F.col("cost")) * F.col("avg_qty"),
        }
    )
    out = out.withColumn("profit_change", F.col("new_profit") - F.col("current_profit"))
    share = F.when(F.col("current_profit") > 0, F.col("profit_change") / F.col("current_profit") * 100)
    return out.withColumn("profit_change_pct", share.otherwise(0.0))
