"""Stock alert, projection and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY
from shelfspark.operators import aggregates as A
from shelfspark.operators import anomaly as N
from shelfspark.operators import inventory as I
from shelfspark.operators import pricing as E
from shelfspark.plans.registry import CTES, query

CTES["stock_now"] = """SELECT l.product_name, l.week_start, l.stock_on_hand AS stock, l.price, m.recent, m.weeks FROM latest l
JOIN (SELECT product_name, AVG(sales_qty) FILTER (age <= 4) AS recent, COUNT(*) AS weeks FROM recent GROUP BY 1) m USING (product_name)"""
CTES["al_days"] = """
WITH d AS (SELECT *, CASE WHEN recent > 0 THEN stock / (recent / 7) ELSE CAST('Infinity' AS DOUBLE) END AS days FROM stock_now)
SELECT product_name, stock AS current_stock, days, CASE WHEN days <= 3 THEN 'CRITICAL' WHEN days <= 7 THEN 'WARNING' ELSE 'OVERSTOCK' END AS urgency,
       CASE WHEN days <= 3 THEN TRUNC(recent * 2) WHEN days <= 7 THEN TRUNC(recent * 1.5) ELSE 0 END AS restock,
       CASE WHEN days <= 3 THEN 'Immediate restock' WHEN days <= 7 THEN 'Plan restock' ELSE 'Consider promotional pricing' END AS action FROM d WHERE days <= 7 OR stock > recent * 8"""
AD = "product_name, urgency, current_stock, days:6, restock:i, action"
query("alerts_days", AD, lambda t: I.alerts_days(t.panel), "SELECT * FROM al_days")
query("sort_custom_rank", "product_name, urgency, rank:i", lambda t: I.sort_custom_rank(I.alerts_days(t.panel)),
      "SELECT product_name, urgency, CASE urgency WHEN 'CRITICAL' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END AS rank FROM al_days")

CTES["al_weeks"] = """
WITH s AS (SELECT product_name, AVG(sales_qty) AS avg_sales, ARG_MAX(stock_on_hand, week_start) AS current_stock, ARG_MIN(category, week_start) AS category, AVG(price) AS avg_price FROM panel GROUP BY 1),
     w AS (SELECT *, current_stock / (avg_sales + 1e-5) AS weeks_remaining FROM s)
SELECT *, CASE WHEN weeks_remaining <= 1 THEN 'CRITICAL' WHEN weeks_remaining <= 2 THEN 'WARNING' ELSE 'OVERSTOCK' END AS urgency,
       CASE WHEN weeks_remaining <= 1 THEN TRUNC(avg_sales * 4) WHEN weeks_remaining <= 2 THEN TRUNC(avg_sales * 3) ELSE 0 END AS suggested_order,
       CASE WHEN weeks_remaining <= 1 THEN TRUNC(avg_sales * avg_price) WHEN weeks_remaining <= 2 THEN TRUNC(avg_sales * avg_price * 0.5) ELSE 0 END AS potential_loss
FROM w WHERE weeks_remaining <= 2 OR weeks_remaining >= 12"""
query("alerts_weeks", "product_name, category, urgency, current_stock, weeks_remaining:6, suggested_order:i, potential_loss:i", lambda t: I.alerts_weeks(t.panel), "SELECT * FROM al_weeks")

CTES["al_pred"] = """
SELECT product_name, TRUNC(stock) AS stock, recent AS predicted_demand, CASE WHEN stock < recent * 1.1 THEN 'Low Stock' WHEN stock > recent * 2 THEN 'Overstock' ELSE 'Optimal' END AS status,
       CASE WHEN stock < recent * 1.1 THEN GREATEST(1, TRUNC(stock / (recent + 1e-6) * 7)) END AS days_to_stockout,
       CASE WHEN stock < recent * 1.1 THEN TRUNC(recent * 4 * 1.5) WHEN stock > recent * 2 THEN 0 ELSE TRUNC(GREATEST(0, recent * 4 - stock)) END AS suggested_reorder_qty
FROM stock_now WHERE weeks >= 8"""
AP = "product_name, stock:i, predicted_demand:6, status, days_to_stockout:i, suggested_reorder_qty:i"
query("alerts_predicted", AP, lambda t: I.alerts_predicted(t.panel), "SELECT * FROM al_pred")

query("alert_level_counts", "low_stock:i, overstock:i, optimal:i, products:i, health_pct:6", lambda t: A.alert_level_counts(I.alerts_predicted(t.panel), t.panel),
      """WITH c AS (SELECT COUNT(*) FILTER (status = 'Low Stock') AS low_stock, COUNT(*) FILTER (status = 'Overstock') AS overstock, COUNT(*) FILTER (status = 'Optimal') AS optimal FROM al_pred),
              p AS (SELECT COUNT(DISTINCT product_name) AS products FROM panel)
         SELECT *, optimal * 100.0 / products AS health_pct FROM c, p""")

RISK = "CASE WHEN {d} < {l} THEN LEAST(100, ({l} - {d}) / {l} * 100) WHEN {d} < {l} + 7 THEN 40 ELSE GREATEST(0, 100 - ({d} - {l} - 7)) END"
LEVEL = "CASE WHEN {d} < {l} THEN 'Critical' WHEN {d} < {l} + 7 THEN 'Warning' ELSE 'Safe' END"


def kpi_sql(growth, lead):
    return f"""
WITH k AS (SELECT *, stock AS current_stock, recent AS recent_sales, {float(growth)} AS growth, {float(lead)}::DOUBLE AS lead, recent * (1 + {growth}::DOUBLE / 100) AS weekly_demand FROM stock_now),
     d AS (SELECT *, CASE WHEN weekly_demand > 0 THEN stock / (weekly_demand / 7) ELSE 999 END AS days FROM k),
     r AS (SELECT *, {LEVEL.format(d='days', l='lead')} AS risk_level, {RISK.format(d='days', l='lead')} AS risk_pct FROM d)
SELECT *, GREATEST(0, weekly_demand * (lead / 7) - stock) AS reorder, CASE WHEN weekly_demand > 0 THEN LEAST(100, stock / (weekly_demand + 1e-6) * 100) ELSE 100 END AS fill_rate,
       stock * price * 0.05 / 365 AS carrying_cost, weekly_demand * 52 / (stock + 1e-6) AS turnover, LEAST(100, GREATEST(0, 100 - risk_pct)) AS health FROM r"""


CTES["kpis"] = kpi_sql(12, 7)


def kpis(t):
    return I.stock_kpis(t.panel, growth=12, lead=7)


query("stock_kpis", "product_name, current_stock, weekly_demand:6, days:6, reorder:6, risk_level, risk_pct:6, fill_rate:6, carrying_cost:6, turnover:4, health:6", kpis, "SELECT * FROM kpis")

_traj = "product_name, day:i, projected:6, stockout_day:i"


def _days(df):
    return df.select(KEY, "stockout_day", F.posexplode("trajectory").alias("day", "projected"))


def _traj_sql(daily, view="kpis"):
    return f"""WITH RECURSIVE p AS (
    SELECT product_name, lead, reorder, 0 AS day, GREATEST(0, current_stock - {daily.format(i=0)}) AS projected FROM {view}
    UNION ALL SELECT p.product_name, p.lead, p.reorder, p.day + 1, GREATEST(0, p.projected + CASE WHEN p.day = p.lead THEN p.reorder ELSE 0 END - {daily.format(i='(p.day + 1)')})
    FROM p JOIN {view} ON p.product_name = {view}.product_name WHERE p.day < 29)
    SELECT p.product_name, day, projected, COALESCE(MIN(CASE WHEN projected <= 0 THEN day END) OVER (PARTITION BY p.product_name), 30) AS stockout_day FROM p"""


query("stock_trajectory", _traj, lambda t: _days(I.stock_trajectory(kpis(t))), _traj_sql("weekly_demand / 7"))

query("stock_levels", "product_name, current_stock, optimal:6, minimum:6, maximum:6, overstock:b, excess:6", lambda t: I.stock_levels(kpis(t)),
      """SELECT product_name, current_stock, weekly_demand * 4 AS optimal, weekly_demand * 2 AS minimum, weekly_demand * 8 AS maximum, current_stock > weekly_demand * 6 AS overstock,
                GREATEST(0, current_stock - weekly_demand * 4) AS excess FROM kpis""")

query("stock_health_trend", "product_name, week_start:d, health:6", lambda t: I.stock_health_trend(t.panel, 7, 52),
      f"""WITH d AS (SELECT *, stock_on_hand / NULLIF(sales_qty / 7, 0) AS days FROM recent WHERE age <= 52)
          SELECT product_name, week_start, CASE WHEN sales_qty > 0 THEN LEAST(100, GREATEST(0, 100 - {RISK.format(d='days', l=7)})) ELSE 50 END AS health FROM d""")

query("stock_health_class", "product_name, mean_stock:6, mean_qty:6, ratio:6, health_status, risk_level:i", lambda t: I.stock_health_class(t.panel),
      """WITH m AS (SELECT product_name, AVG(stock_on_hand) AS mean_stock, AVG(sales_qty) AS mean_qty FROM panel GROUP BY 1), r AS (SELECT *, mean_stock / (mean_qty + 1e-6) AS ratio FROM m)
         SELECT *, CASE WHEN ratio < 0.5 THEN 'Critical' WHEN ratio < 1 THEN 'Warning' WHEN ratio < 2 THEN 'Optimal' ELSE 'Overstock' END AS health_status,
                CASE WHEN ratio < 0.5 THEN 4 WHEN ratio < 1 THEN 3 WHEN ratio < 2 THEN 2 ELSE 1 END AS risk_level FROM r""")

query("demand_variability", "product_name, n:i, cv_pct:6, status, action", lambda t: I.demand_variability(t.panel),
      """WITH c AS (SELECT product_name, COUNT(*) AS n, STDDEV_SAMP(sales_qty) / (AVG(sales_qty) + 1e-6) * 100 AS cv_pct FROM panel GROUP BY 1 HAVING COUNT(*) > 10)
         SELECT *, CASE WHEN cv_pct > 30 THEN 'High Volatility' WHEN cv_pct > 15 THEN 'Moderate Volatility' ELSE 'Stable Demand' END AS status,
                CASE WHEN cv_pct > 30 THEN 'Increase safety stock' WHEN cv_pct > 15 THEN 'Monitor weekly patterns' ELSE 'Standard replenishment' END AS action FROM c""")

query("peak_preparation", "product_name, peak_month:i, increase_pct:6, stock_increase:i", lambda t: I.peak_preparation(t.panel),
      """WITH l AS (SELECT product_name, peak_month, (peak_qty - mean_of_means) / (mean_of_means + 1e-6) * 100 AS increase_pct FROM month_prof)
         SELECT *, LEAST(30, GREATEST(10, TRUNC(increase_pct * 0.8))) AS stock_increase FROM l""")

_scen = [("faster restock", 0, -2), ("more growth", 8, 0), ("slower restock", 0, 5)]
query("stock_whatif", "product_name, scenario, sim_demand:6, sim_days:6, sim_level, sim_risk:6, delta_days:6, health_change:6", lambda t: I.stock_whatif(kpis(t), _scen),
      f"""WITH s AS (SELECT kpis.*, scenario, recent_sales * (1 + (growth + g) / 100) AS sim_demand, GREATEST(5.0, lead + dl) AS sim_lead FROM kpis,
                     (VALUES {', '.join(f"('{n}', {g}, {d})" for n, g, d in _scen)}) v(scenario, g, dl)),
               d AS (SELECT *, CASE WHEN sim_demand > 0 THEN stock / (sim_demand / 7) ELSE 999 END AS sim_days FROM s),
               r AS (SELECT *, {LEVEL.format(d='sim_days', l='sim_lead')} AS sim_level, {RISK.format(d='sim_days', l='sim_lead')} AS sim_risk FROM d)
          SELECT *, sim_days - days AS delta_days, GREATEST(0, 100 - sim_risk) - health AS health_change FROM r""")

query("stock_alert_messages", "product_name, severity, message, action, amount:6", lambda t: I.stock_alert_messages(kpis(t)),
      """SELECT product_name, 'Critical' AS severity, 'Stock ends before the restock' AS message, 'Place emergency order' AS action, days AS amount FROM kpis WHERE days < lead
         UNION ALL SELECT product_name, 'Warning', 'Reorder exceeds twice the stock', 'Review supplier capabilities', reorder FROM kpis WHERE reorder > current_stock * 2
         UNION ALL SELECT product_name, 'Info', 'Carrying cost at 5 percent', 'Optimize reorder frequency', current_stock * 0.05 FROM kpis WHERE weekly_demand > 0
         UNION ALL SELECT product_name, 'Growth', 'Demand is projected to grow', 'Scale up inventory buffer', growth FROM kpis WHERE growth > 10
         UNION ALL SELECT product_name, 'Overstock', 'Stock above one and a half times optimal', 'Promote or reduce next order', current_stock - weekly_demand * 4 FROM kpis WHERE current_stock > weekly_demand * 6""")

CTES["plain_path"] = "SELECT product_name, stock AS current_stock, recent AS weekly_demand, -1.0 AS lead, 0.0 AS reorder FROM stock_now"
query("alerts_enriched", "product_name, urgency, day:i, projected:6, predicted_days_to_stockout:i",
      lambda t: I.alerts_enriched(I.alerts_days(t.panel), t.panel).select(KEY, "urgency", "predicted_days_to_stockout", F.posexplode("trajectory").alias("day", "projected")),
      f"""WITH RECURSIVE p AS (SELECT product_name, weekly_demand / 7 AS d, 0 AS day, GREATEST(0, current_stock - weekly_demand / 7) AS projected FROM plain_path
             UNION ALL SELECT product_name, d, day + 1, GREATEST(0, projected - d) FROM p WHERE day < 29)
          SELECT p.product_name, urgency, day, projected, COALESCE(MIN(CASE WHEN projected <= 0 THEN day END) OVER (PARTITION BY p.product_name), 30) AS predicted_days_to_stockout FROM p JOIN al_days USING (product_name)""")

query("semi_alert_products", AD, lambda t: A.semi_alert_products(I.alerts_days(t.panel), t.panel.filter("holiday_flag = 1")),
      "SELECT * FROM al_days WHERE product_name IN (SELECT product_name FROM panel WHERE holiday_flag = 1)")

query("reorder_plan", "product_name, recommended_qty:6, current_stock, reorder_date:d, restock_date:d, urgency, lead:2, weekly_demand:6, days:6", lambda t: I.reorder_plan(kpis(t)),
      """SELECT product_name, reorder AS recommended_qty, current_stock, week_start AS reorder_date, week_start + 7 AS restock_date,
                CASE WHEN days <= 5 THEN 'Critical' WHEN days <= 15 THEN 'Moderate' ELSE 'Safe' END AS urgency, lead, weekly_demand, days FROM kpis""")

query("exec_kpis", "products:i, total_qty:2, total_revenue:2, avg_price:6, critical:i, warning:i, overstock:i", lambda t: A.exec_kpis(t.panel, I.alerts_weeks(t.panel)),
      """SELECT COUNT(DISTINCT product_name) AS products, SUM(sales_qty) AS total_qty, SUM(price * sales_qty) AS total_revenue, AVG(price) AS avg_price,
                (SELECT COUNT(*) FROM al_weeks WHERE urgency = 'CRITICAL') AS critical, (SELECT COUNT(*) FROM al_weeks WHERE urgency = 'WARNING') AS warning,
                (SELECT COUNT(*) FROM al_weeks WHERE urgency = 'OVERSTOCK') AS overstock FROM panel""")


def _reports(t):
    return {
        "alerts": I.alerts_weeks(t.panel), "anomalies": N.anomaly_hybrid(t.panel),
        "seasonal": A.category_seasonality(t.panel), "pricing": E.price_sensitivity(t.panel),
    }


query("completion_report", "alerts:i, anomalies:i, seasonal:i, pricing:i", lambda t: A.completion_report(**_reports(t)),
      """SELECT (SELECT COUNT(*) FROM al_weeks) AS alerts, (SELECT COUNT(*) FROM anoms) AS anomalies, (SELECT COUNT(*) FROM cat_season) AS seasonal, (SELECT COUNT(*) FROM sens) AS pricing""")
