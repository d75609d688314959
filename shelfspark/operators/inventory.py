"""Stock alerts, projections and what-if figures for all products at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY, TIME, clip_col, each, newest_first, trunc
from shelfspark.operators.aggregates import month_profile
from shelfspark.operators.windows import last_n_mean

EPS = 1e-6
# Order in which alert levels are listed.
ALERT_ORDER = ["CRITICAL", "WARNING", "OVERSTOCK"]


def latest_stock(panel: DataFrame) -> DataFrame:
    """Newest week, stock, price and quantity per product with its 4-week mean quantity."""
    last = panel.groupBy(KEY).agg(
        F.max(F.struct(TIME, "stock_on_hand", "price", "sales_qty")).alias("r"), F.count(F.lit(1)).alias("weeks")
    )
    return last.select(KEY, "weeks", "r.*").join(last_n_mean(panel, 4), KEY)


def alerts_days(panel: DataFrame) -> DataFrame:
    """Alerts by days of stock at the recent rate of sale; products without one are left out."""
    recent, stock = F.col("mean_last_4"), F.col("stock_on_hand")
    out = latest_stock(panel).withColumn("days", F.when(recent > 0, stock / (recent / 7)).otherwise(F.lit(float("inf"))))
    days = F.col("days")
    level = F.when(days <= 3, "CRITICAL").when(days <= 7, "WARNING").when(stock > recent * 8, "OVERSTOCK")
    order = F.when(days <= 3, trunc(recent * 2)).when(days <= 7, trunc(recent * 1.5)).otherwise(0)
    todo = F.when(days <= 3, "Immediate restock").when(days <= 7, "Plan restock").otherwise("Consider promotional pricing")
    out = out.withColumns({"urgency": level, "restock": order, "action": todo}).filter("urgency IS NOT NULL")
    return out.select(KEY, "urgency", F.col("stock_on_hand").alias("current_stock"), "days", "restock", "action")


def sort_custom_rank(alerts: DataFrame) -> DataFrame:
    """Alerts in the order CRITICAL, WARNING, OVERSTOCK."""
    rank = F.lit(len(ALERT_ORDER))
    for i, level in enumerate(ALERT_ORDER):
        rank = F.when(F.col("urgency") == level, i).otherwise(rank)
    return alerts.withColumn("rank", rank).orderBy("rank", KEY)


def alerts_weeks(panel: DataFrame) -> DataFrame:
    """Alerts by weeks of stock at the mean rate of sale."""
    out = panel.groupBy(KEY).agg(
        F.avg("sales_qty").alias("avg_sales"), F.max_by("stock_on_hand", TIME).alias("current_stock"),
        F.min_by("category", TIME).alias("category"), F.avg("price").alias("avg_price"),
    )
    out = out.withColumn("weeks_remaining", F.col("current_stock") / (F.col("avg_sales") + 1e-5))
    w, sales, price = F.col("weeks_remaining"), F.col("avg_sales"), F.col("avg_price")
    level = F.when(w <= 1, "CRITICAL").when(w <= 2, "WARNING").when(w >= 12, "OVERSTOCK")
    order = F.when(w <= 1, trunc(sales * 4)).when(w <= 2, trunc(sales * 3)).otherwise(0)
    loss = F.when(w <= 1, trunc(sales * price)).when(w <= 2, trunc(sales * price * 0.5)).otherwise(0)
    return out.withColumns({"urgency": level, "suggested_order": order, "potential_loss": loss}).filter("urgency IS NOT NULL")


def predicted_alerts(demand: DataFrame, horizon: int = 4) -> DataFrame:
    """Stock status against a predicted week (predicted_demand, stock_on_hand)."""
    stock, pred = F.coalesce("stock_on_hand", F.lit(0.0)), F.col("predicted_demand")
    low, over = stock < pred * 1.1, stock > pred * 2
    days = F.greatest(F.lit(1), trunc(stock / (pred + EPS) * 7))
    order = F.when(low, trunc(pred * horizon * 1.5)).when(over, 0).otherwise(trunc(F.greatest(F.lit(0.0), pred * horizon - stock)))
    return demand.select(
        KEY, trunc(stock).alias("stock"), "predicted_demand",
        F.when(low, "Low Stock").when(over, "Overstock").otherwise("Optimal").alias("status"),
        F.when(low, days).alias("days_to_stockout"), order.alias("suggested_reorder_qty"),
    )


def alerts_predicted(panel: DataFrame, horizon: int = 4, mode: str = "ma4") -> DataFrame:
    """Alerts on the predicted next week of products with 8 or more weeks.

    "ma4" takes the 4-week mean as the prediction; "model" takes the pooled boosted trees.
    """
    if mode == "model":
        from shelfspark.operators.models import next_week_demand

        return predicted_alerts(next_week_demand(panel), horizon)
    demand = latest_stock(panel).filter("weeks >= 8").withColumn("predicted_demand", F.col("mean_last_4"))
    return predicted_alerts(demand, horizon)


def risk(days: Column, lead: Column) -> tuple[Column, Column]:
    """Risk level and percent from the days of stock and the lead time in days."""
    short, near = days < lead, days < lead + 7
    level = F.when(short, "Critical").when(near, "Warning").otherwise("Safe")
    share = F.when(short, F.least(F.lit(100.0), (lead - days) / lead * 100)).when(near, 40.0)
    return level, share.otherwise(F.greatest(F.lit(0.0), 100 - (days - lead - 7)))


def days_of(stock: Column, weekly: Column) -> Column:
    return F.when(weekly > 0, stock / (weekly / 7)).otherwise(999.0)


def stock_kpis(panel: DataFrame, growth: float = 0, lead: int = 7) -> DataFrame:
    """Demand, days of stock, reorder, risk, fill rate, carrying cost, turnover and health per product."""
    out = latest_stock(panel).withColumns(
        {
            "current_stock": F.col("stock_on_hand"), "recent_sales": F.col("mean_last_4"), "growth": F.lit(float(growth)),
            "lead": F.lit(float(lead)), "weekly_demand": F.col("mean_last_4") * (1 + growth / 100),
        }
    )
    stock, weekly = F.col("current_stock"), F.col("weekly_demand")
    out = out.withColumn("days", days_of(stock, weekly))
    level, share = risk(F.col("days"), F.col("lead"))
    out = out.withColumns({"risk_level": level, "risk_pct": share})
    return out.select(
        KEY, TIME, "price", "current_stock", "recent_sales", "growth", "lead", "weekly_demand", "days",
        F.greatest(F.lit(0.0), weekly * (F.col("lead") / 7) - stock).alias("reorder"), "risk_level", "risk_pct",
        F.when(weekly > 0, F.least(F.lit(100.0), stock / (weekly + EPS) * 100)).otherwise(100.0).alias("fill_rate"),
        (stock * F.col("price") * 0.05 / 365).alias("carrying_cost"),
        (weekly * 52 / (stock + EPS)).alias("turnover"),
        clip_col(100 - F.col("risk_pct"), 0.0, 100.0).alias("health"),
    )


def stock_trajectory(kpis: DataFrame, fc: DataFrame | None = None, days: int = 30, literal_growth: bool = False) -> DataFrame:
    """Projected stock per day as an array and the first day without stock.

    The reorder arrives after the day whose index is the lead time. `fc` (product_name,
    week 0.., yhat) replaces the mean demand week by week. `literal_growth` applies the
    growth a second time.
    """
    grow = 1 + F.col("growth") / 100
    flat = F.col("weekly_demand") / 7 * (grow if literal_growth else F.lit(1.0))
    df = kpis
    if fc is None:
        df = df.withColumn("__daily", F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: flat))
    else:
        weeks = fc.filter(F.col("week") < F.ceil(F.lit(days) / 7)).groupBy(KEY).agg(
            F.map_from_entries(F.collect_list(F.struct("week", "yhat"))).alias("__fc")  # at most ceil(days / 7) weeks
        )
        df = df.join(weeks, KEY, "left")
        ahead = lambda i: F.try_element_at("__fc", F.floor(i / 7).cast("int"))
        df = df.withColumn(
            "__daily",
            F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.coalesce(ahead(i) / 7 * grow, flat)),
        ).drop("__fc")

    def step(acc, i):
        left = F.greatest(F.lit(0.0), acc["s"] - F.get(F.col("__daily"), i))
        back = F.when(i.cast("double") == F.col("lead"), left + F.col("reorder")).otherwise(left)
        return F.struct(back.alias("s"), F.concat(acc["a"], F.array(left)).alias("a"))

    start = F.struct(F.col("current_stock").alias("s"), F.array().cast("array<double>").alias("a"))
    path = F.aggregate(F.sequence(F.lit(0), F.lit(days - 1)), start, step, lambda acc: acc["a"])
    out = df.withColumn("trajectory", path).drop("__daily")
    empty = F.array_position(F.transform("trajectory", lambda s: s <= 0), True)
    return out.withColumn("stockout_day", F.when(empty > 0, empty - 1).otherwise(days).cast("int"))


def stock_levels(kpis: DataFrame) -> DataFrame:
    weekly, stock = F.col("weekly_demand"), F.col("current_stock")
    return kpis.select(
        KEY, "current_stock", (weekly * 4).alias("optimal"), (weekly * 2).alias("minimum"), (weekly * 8).alias("maximum"),
        (stock > weekly * 4 * 1.5).alias("overstock"), F.greatest(F.lit(0.0), stock - weekly * 4).alias("excess"),
    )


def stock_health_trend(panel: DataFrame, lead: int = 7, n: int = 52) -> DataFrame:
    """Health index 0..100 of each of the last n weeks; 50 without demand."""
    rows = panel.withColumn("__rn", F.row_number().over(newest_first())).filter(F.col("__rn") <= n)
    qty = F.coalesce("sales_qty", F.lit(1.0))
    _, share = risk(F.try_divide(F.col("stock_on_hand"), qty / 7), F.lit(float(lead)))
    return rows.select(KEY, TIME, F.when(qty > 0, clip_col(100 - share, 0.0, 100.0)).otherwise(50.0).alias("health"))


def stock_health_class(panel: DataFrame) -> DataFrame:
    out = panel.groupBy(KEY).agg(F.avg("stock_on_hand").alias("mean_stock"), F.avg("sales_qty").alias("mean_qty"))
    out = out.withColumn("ratio", F.col("mean_stock") / (F.col("mean_qty") + EPS))
    r = F.col("ratio")
    return out.withColumns(
        {
            "health_status": F.when(r < 0.5, "Critical").when(r < 1, "Warning").when(r < 2, "Optimal").otherwise("Overstock"),
            "risk_level": F.when(r < 0.5, 4).when(r < 1, 3).when(r < 2, 2).otherwise(1),
        }
    )


def demand_variability(panel: DataFrame) -> DataFrame:
    out = panel.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), F.avg("sales_qty").alias("mean_qty"), F.stddev_samp("sales_qty").alias("std_qty")
    ).filter("n > 10")
    out = out.withColumn("cv_pct", F.col("std_qty") / (F.col("mean_qty") + EPS) * 100)
    cv = F.col("cv_pct")
    return out.withColumns(
        {
            "status": F.when(cv > 30, "High Volatility").when(cv > 15, "Moderate Volatility").otherwise("Stable Demand"),
            "action": F.when(cv > 30, "Increase safety stock").when(cv > 15, "Monitor weekly patterns").otherwise("Standard replenishment"),
        }
    )


def peak_preparation(panel: DataFrame) -> DataFrame:
    """Peak month, its lift over the mean month and the advised stock increase in percent."""
    p = month_profile(panel)
    lift = (F.col("peak_qty") - F.col("mean_of_means")) / (F.col("mean_of_means") + EPS) * 100
    out = p.select(KEY, "peak_month", lift.alias("increase_pct"))
    return out.withColumn("stock_increase", clip_col(trunc(F.col("increase_pct") * 0.8), 10, 30))


def stock_whatif(kpis: DataFrame, scenarios: list[tuple[str, float, int]]) -> DataFrame:
    """Days of stock, risk and health change per (name, extra growth in percent, lead time change in days)."""
    out = each(kpis, ["scenario", "add_growth", "add_lead"], [(n, float(g), int(d)) for n, g, d in scenarios])
    out = out.withColumns(
        {
            "sim_demand": F.col("recent_sales") * (1 + (F.col("growth") + F.col("add_growth")) / 100),
            "sim_lead": F.greatest(F.lit(5.0), F.col("lead") + F.col("add_lead")),
        }
    )
    out = out.withColumn("sim_days", days_of(F.col("current_stock"), F.col("sim_demand")))
    level, share = risk(F.col("sim_days"), F.col("sim_lead"))
    out = out.withColumns({"sim_level": level, "sim_risk": share})
    health = F.greatest(F.lit(0.0), 100 - F.col("sim_risk"))
    return out.withColumns({"delta_days": F.col("sim_days") - F.col("days"), "health_change": health - F.col("health")})


def stock_alert_messages(kpis: DataFrame) -> DataFrame:
    """One row per rule that fires for a product."""
    stock, weekly = F.col("current_stock"), F.col("weekly_demand")

    def rule(cond, severity, message, action, amount):
        return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"),
                                     F.lit(action).alias("action"), amount.cast("double").alias("amount")))

    rules = F.array_compact(
        F.array(
            rule(F.col("days") < F.col("lead"), "Critical", "Stock ends before the restock", "Place emergency order", F.col("days")),
            rule(F.col("reorder") > stock * 2, "Warning", "Reorder exceeds twice the stock", "Review supplier capabilities", F.col("reorder")),
            rule(weekly > 0, "Info", "Carrying cost at 5 percent", "Optimize reorder frequency", stock * 0.05),
            rule(F.col("growth") > 10, "Growth", "Demand is projected to grow", "Scale up inventory buffer", F.col("growth")),
            rule(stock > weekly * 4 * 1.5, "Overstock", "Stock above one and a half times optimal", "Promote or reduce next order", stock - weekly * 4),
        )
    )
    return kpis.select(KEY, F.explode(rules).alias("m")).select(KEY, "m.*")


def alerts_enriched(alerts: DataFrame, panel: DataFrame, days: int = 30) -> DataFrame:
    """Alerts with their projected stock and predicted day without stock; unknown products keep nulls."""
    kpis = latest_stock(panel).select(
        KEY, F.col("stock_on_hand").alias("current_stock"), F.col("mean_last_4").alias("weekly_demand"),
        F.lit(0.0).alias("growth"), F.lit(-1.0).alias("lead"), F.lit(0.0).alias("reorder"),
    )
    path = stock_trajectory(kpis, days=days).select(KEY, "trajectory", F.col("stockout_day").alias("predicted_days_to_stockout"))
    return alerts.join(path, KEY, "left")


def reorder_plan(kpis: DataFrame) -> DataFrame:
    """Quantity, dates and urgency per product; the newest week of the data stands for today."""
    days = F.col("days")
    return kpis.select(
        KEY, F.col("reorder").alias("recommended_qty"), "current_stock", F.col(TIME).alias("reorder_date"),
        F.date_add(TIME, F.col("lead").cast("int")).alias("restock_date"),
        F.when(days <= 5, "Critical").when(days <= 15, "Moderate").otherwise("Safe").alias("urgency"),
        "lead", "weekly_demand", "days",
    )
