"""Elasticity, price grids, recommendations and price strategies."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY, TIME, by, places, rows
from shelfspark.functions.stats import sized_join
from shelfspark.operators import aggregates as A
from shelfspark.operators import pricing as E
from shelfspark.operators import strategies as S
from shelfspark.operators.windows import change
from shelfspark.plans.registry import CTES, query
from shelfspark.session import written

_w = "PARTITION BY product_name ORDER BY week_start"

CTES["elas"] = f"""
WITH s AS (SELECT *, price / LAG(price) OVER ({_w}) - 1 AS dp, sales_qty / LAG(sales_qty) OVER ({_w}) - 1 AS dq FROM panel),
     k AS (SELECT *, ABS(dp) > 0.01 AND ABS(dp) < 1 AND ABS(dq) < 2 AS kept FROM s)
SELECT product_name, COUNT(*) AS n, COUNT(DISTINCT price) AS prices, COUNT(*) FILTER (kept) AS kept,
       CASE WHEN COUNT(*) < 12 OR COUNT(DISTINCT price) < 3 OR COUNT(*) FILTER (kept) < 5 THEN -1.2
            ELSE COALESCE(REGR_SLOPE(LN(sales_qty + 1e-6), LN(price + 1e-6)) FILTER (kept), -1.2) END AS elasticity
FROM k GROUP BY 1"""
query("elasticity_gated", "product_name, n:i, prices:i, kept:i, elasticity:6", lambda t: E.elasticity_gated(t.panel), "SELECT * FROM elas")

CTES["elas_simple"] = """SELECT product_name, COUNT(*) AS n, CASE WHEN COUNT(*) < 12 OR COUNT(DISTINCT price) < 3 THEN -1.2
    ELSE COALESCE(REGR_SLOPE(LN(sales_qty + 1e-6), LN(price + 1e-6)), -1.2) END AS elasticity FROM panel GROUP BY 1"""
query("elasticity_simple", "product_name, n:i, elasticity:6", lambda t: E.elasticity_simple(t.panel), "SELECT * FROM elas_simple")

CTES["elas_ridge"] = """
WITH s AS (SELECT *, price / LAG(price) OVER o - 1 AS dp, sales_qty / LAG(sales_qty) OVER o - 1 AS dq,
                  LN(price + 1e-6) AS x, LN(sales_qty + 1e-6) AS y FROM panel WINDOW o AS (PARTITION BY product_name ORDER BY price, week_start)),
     m AS (SELECT product_name, COUNT(*) AS n, AVG(dp) FILTER (dp <> 0 AND dq IS NOT NULL) AS mp, AVG(dq) FILTER (dp <> 0 AND dq IS NOT NULL) AS mq,
                  COVAR_POP(y, x) * COUNT(*) AS sxy, VAR_POP(x) * COUNT(*) AS sxx, VAR_POP(y) * COUNT(*) AS syy FROM s GROUP BY 1),
     b AS (SELECT *, sxy / (sxx + 0.1) AS slope, CASE WHEN mp IS NULL THEN -1.5 ELSE -COALESCE(mq / NULLIF(mp, 0), -1.5) END AS simple FROM m),
     r AS (SELECT *, 1 - (syy - 2 * slope * sxy + slope * slope * sxx) / NULLIF(syy, 0) AS r2 FROM b),
     e AS (SELECT product_name, n AS data_points, CASE WHEN n < 8 THEN -1.5 WHEN r2 > 0.3 THEN slope ELSE simple END AS elasticity,
                  CASE WHEN n < 8 THEN 0 WHEN r2 > 0.3 THEN r2 ELSE 0.5 END AS r2_score,
                  CASE WHEN n < 8 THEN 'default' WHEN r2 > 0.3 THEN 'log-log' ELSE 'simple' END AS method FROM r)
SELECT *, CASE WHEN method = 'default' THEN 'Insufficient Data' WHEN elasticity < -1 THEN 'Elastic' WHEN elasticity < 0 THEN 'Inelastic' ELSE 'Neutral' END AS classification FROM e"""
query("elasticity_ridge", "product_name, data_points:i, elasticity:6, r2_score:6, method, classification",
      lambda t: E.elasticity_ridge(t.panel), "SELECT * FROM elas_ridge")

query("elasticity_class", "product_name, elasticity:6, classification, label", lambda t: E.elasticity_class(E.elasticity_gated(t.panel)),
      """SELECT product_name, elasticity, CASE WHEN elasticity < -1 THEN 'Elastic' WHEN elasticity < 0 THEN 'Inelastic' ELSE 'Neutral' END AS classification,
                CASE WHEN elasticity < -1 THEN 'Elastic' WHEN elasticity > -0.5 THEN 'Inelastic' ELSE 'Unit-Elastic' END AS label FROM elas""")

CTES["pbase"] = """SELECT product_name, avg_price, avg_qty, current_price, weeks, elasticity FROM (
    SELECT product_name, AVG(price) AS avg_price, AVG(sales_qty) AS avg_qty, ARG_MAX(price, week_start) AS current_price, COUNT(*) AS weeks FROM panel GROUP BY 1)
    JOIN elas USING (product_name)"""

CTES["opps"] = """
WITH c AS (SELECT *, CASE WHEN elasticity < -1 THEN -5.0 WHEN elasticity > -0.5 THEN 5.0 ELSE 0.0 END AS change_pct FROM pbase)
SELECT *, avg_price * avg_qty AS current_revenue, avg_price * (1 + change_pct / 100) * (avg_qty * (1 + elasticity * change_pct / 100)) AS projected_revenue,
       avg_price * (1 + change_pct / 100) * (avg_qty * (1 + elasticity * change_pct / 100)) - avg_price * avg_qty AS revenue_gain,
       CASE WHEN elasticity < -1 THEN 'Consider price reduction' WHEN elasticity > -0.5 THEN 'Price increase opportunity' ELSE 'Maintain current pricing' END AS recommendation FROM c"""


def gated(t):
    return E.elasticity_gated(t.panel)


query("pricing_opportunities", "product_name, avg_price:6, elasticity:6, recommendation, change_pct:2, current_revenue:3, projected_revenue:3, revenue_gain:3",
      lambda t: E.pricing_opportunities(t.panel, gated(t)), "SELECT * FROM opps")

CTES["sens"] = """
WITH s AS (SELECT product_name, ARG_MIN(category, week_start) AS category, COUNT(*) AS n, STDDEV_SAMP(price) AS sd, CORR(price, sales_qty) AS corr,
                  ARG_MAX(price, week_start) AS current_price, AVG(sales_qty) AS avg_sales FROM panel GROUP BY 1)
SELECT *, avg_sales * ABS(corr) AS priority, CASE WHEN corr < -0.3 THEN 'PRICE SENSITIVE' WHEN corr > 0.3 THEN 'PREMIUM OPPORTUNITY' ELSE 'PRICE INELASTIC' END AS insight_type,
       CASE WHEN corr < -0.3 THEN 'Test a 5-10% price reduction' WHEN corr > 0.3 THEN 'Test a 5-15% price increase' ELSE 'Work on cost instead of price' END AS suggested_action
FROM s WHERE n >= 4 AND sd > 0 AND (ABS(corr) > 0.3 OR ABS(corr) < 0.1)"""
_sens = "product_name, category, corr:6, current_price:9, avg_sales:6, priority:6, insight_type, suggested_action"
query("price_sensitivity", _sens, lambda t: E.price_sensitivity(t.panel), "SELECT * FROM sens")
query("priority_rank", "product_name, priority:6", lambda t: E.priority_rank(E.price_sensitivity(t.panel)), "SELECT product_name, priority FROM sens")

for _key, _book in (("markup_rule", False), ("markup_rule_textbook", True)):
    query(_key, "product_name, cost:6, optimal_price:6, price_change_pct:6, qty_change_pct:6, profit_gain:6, profit_gain_pct:6",
          lambda t, b=_book: E.markup_rule(E.priced(t.panel, E.elasticity_ridge(t.panel)).withColumn("price", F.col("current_price")), 0.3, b),
          f"""WITH b AS (SELECT product_name, current_price AS p, r.elasticity AS e, current_price * (1 - 0.3) AS cost FROM pbase JOIN elas_ridge r USING (product_name)),
                  o AS (SELECT *, GREATEST(cost * 1.1, CASE WHEN e < -1 THEN cost / (1 + 1 / {'e' if _book else 'ABS(e)'}) ELSE p * 1.1 END) AS optimal_price FROM b),
                  q AS (SELECT *, e * ((optimal_price - p) / p) * 100 AS qty_change_pct FROM o),
                  g AS (SELECT *, (optimal_price - cost) * (1 + qty_change_pct / 100) - (p - cost) AS profit_gain FROM q)
             SELECT product_name, cost, optimal_price, (optimal_price - p) / p * 100 AS price_change_pct, qty_change_pct, profit_gain, profit_gain / (p - cost) * 100 AS profit_gain_pct FROM g""")

CTES["zones"] = """
WITH p AS (SELECT *, avg_price AS base_price, avg_price * (1 + 0.1 * (1 / (1 + EXP(-elasticity)))) AS opt_price, avg_price * 0.95 AS aggressive_price, avg_price * 1.10 AS premium_price FROM pbase),
     d AS (SELECT *, avg_qty AS base_demand, avg_qty * POW(opt_price / avg_price, elasticity) AS opt_demand, avg_qty * POW(aggressive_price / avg_price, elasticity) AS aggressive_demand,
                  avg_qty * POW(premium_price / avg_price, elasticity) AS premium_demand FROM p),
     r AS (SELECT *, base_price * base_demand AS base_revenue, opt_price * opt_demand AS opt_revenue, aggressive_price * aggressive_demand AS aggressive_revenue,
                  premium_price * premium_demand AS premium_revenue FROM d),
     t AS (SELECT *, GREATEST(base_revenue, opt_revenue, aggressive_revenue, premium_revenue) AS top FROM r)
SELECT *, CASE WHEN opt_revenue = top THEN 'Optimal' WHEN aggressive_revenue = top THEN 'Aggressive' WHEN premium_revenue = top THEN 'Premium' ELSE 'Base' END AS optimal_zone,
       (top - base_revenue) / base_revenue * 100 AS revenue_gain_pct FROM t"""


def zones(t):
    return E.price_zones(t.panel, gated(t))


query("price_zones", """product_name, base_price:6, opt_price:6, aggressive_price:6, premium_price:6, base_demand:6, opt_demand:6, aggressive_demand:6, premium_demand:6,
      base_revenue:3, opt_revenue:3, aggressive_revenue:3, premium_revenue:3, optimal_zone, elasticity:6, revenue_gain_pct:6""", zones, "SELECT * FROM zones")

query("whatif_price", "product_name, change_pct:2, new_price:6, new_demand:6, current_revenue:3, new_revenue:3, revenue_delta:3, revenue_delta_pct:6, direction, price_elastic:b",
      lambda t: E.whatif_price(t.panel, gated(t)),
      """WITH c AS (SELECT pbase.*, change_pct, avg_price * (1 + change_pct / 100) AS new_price FROM pbase, (VALUES (-10.0::DOUBLE), (-5.0), (5.0), (10.0)) v(change_pct)),
              d AS (SELECT *, avg_qty * POW(new_price / avg_price, elasticity) AS new_demand, avg_price * avg_qty AS current_revenue FROM c),
              r AS (SELECT *, new_price * new_demand AS new_revenue, new_price * new_demand - current_revenue AS revenue_delta FROM d)
         SELECT *, revenue_delta / current_revenue * 100 AS revenue_delta_pct, CASE WHEN revenue_delta > 0 THEN 'raises revenue' ELSE 'reduces revenue' END AS direction,
                ABS(elasticity) > 1 AS price_elastic FROM r""")


def _grid_sql(lo, hi, n, price="current_price"):
    return f"SELECT pbase.*, i AS step, {price} * {lo} + i * (({price} * {hi} - {price} * {lo}) / {n - 1}) AS candidate FROM pbase, range({n}) r(i)"


query("cross_price_grid", "product_name, step:i, candidate:6",
      lambda t: E.cross_price_grid(E.priced(t.panel, gated(t)), 0.7, 1.3, 50, "current_price"), _grid_sql(0.7, 1.3, 50))

CTES["curve50"] = f"""
WITH g AS (SELECT *, current_price * 0.5 AS cost, (candidate - current_price) / current_price * 100 AS change_pct FROM ({_grid_sql(0.7, 1.3, 50)})),
     q AS (SELECT *, avg_qty * GREATEST(0.1, 1 + elasticity * change_pct / 100) AS qty FROM g)
SELECT *, candidate * qty AS revenue, (candidate - cost) * qty AS profit FROM q"""


def curve50(t):
    return E.profit_curve_50(t.panel, gated(t))


query("profit_curve_50", "product_name, step:i, candidate:6, change_pct:6, qty:6, revenue:3, profit:3", curve50, "SELECT * FROM curve50")
query("argmax_grid", "product_name, step:i, candidate:6, qty:6, revenue:3, profit:3", lambda t: E.argmax_grid(curve50(t), "profit"),
      "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY profit DESC, step) AS rn FROM curve50) WHERE rn = 1")

query("profit_scan_5", "product_name, avg_price:6, elasticity:6, recommended_price:6, revenue_change_pct:6",
      lambda t: E.profit_scan_5(t.panel, gated(t)),
      """WITH g AS (SELECT pbase.*, s, avg_price * f AS tp FROM pbase, (VALUES (0, 0.9::DOUBLE), (1, 0.95), (2, 1.0), (3, 1.05), (4, 1.1)) v(s, f) WHERE weeks >= 12),
              p AS (SELECT *, tp * 0.5 * (avg_qty * (1 + elasticity * ((tp - avg_price) / avg_price * 100) / 100)) AS profit FROM g),
              b AS (SELECT *, CASE WHEN profit > 0 THEN tp ELSE avg_price END AS recommended_price FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY profit DESC, s) = 1)
         SELECT *, (recommended_price * (avg_qty * (1 + elasticity * ((recommended_price - avg_price) / avg_price) * 100 / 100)) - avg_price * avg_qty) / (avg_price * avg_qty) * 100 AS revenue_change_pct FROM b""")

query("profit_curve_competitor", "product_name, step:i, candidate:6, qty:6, profit:3, competitive_profit:3",
      lambda t: E.profit_curve_competitor(t.panel, gated(t), surge=0.25),
      f"""WITH g AS (SELECT *, current_price * (1 - 0.3) AS cost, current_price * 0.95 AS competitor, (candidate - current_price) / current_price * 100 AS change_pct FROM ({_grid_sql(0.8, 1.2, 100)})),
               a AS (SELECT *, elasticity + 0.1 * ABS((competitor - current_price) / current_price * 100) / 10 AS adj, 0.1 * ((competitor - candidate) / current_price) * 100 AS pull FROM g),
               q AS (SELECT *, avg_qty * GREATEST(0.1, 1 + elasticity * change_pct / 100 + 0.25) AS qty, avg_qty * GREATEST(0.1, 1 + adj * change_pct / 100 + pull / 100) AS qc FROM a)
          SELECT *, (candidate - cost) * qty AS profit, (candidate - cost) * qc AS competitive_profit FROM q""")

query("elasticity_curve", "product_name, step:i, candidate:6, demand:6, revenue:3, best_price:6, band",
      lambda t: E.elasticity_curve(t.panel, gated(t)),
      f"""WITH d AS (SELECT *, avg_qty * POW(candidate / avg_price, elasticity) AS demand, candidate * (avg_qty * POW(candidate / avg_price, elasticity)) AS revenue FROM ({_grid_sql(0.7, 1.3, 50, 'avg_price')})),
               b AS (SELECT *, FIRST_VALUE(candidate) OVER (PARTITION BY product_name ORDER BY revenue DESC, step) AS best_price FROM d)
          SELECT *, CASE WHEN candidate < best_price THEN 'under-priced' WHEN candidate > best_price THEN 'over-priced' ELSE 'optimal' END AS band FROM b""")

query("pricing_profile", "product_name, seasonality:6, promotions:6, demand_sensitivity:6, profit_margin:6, model_confidence:6",
      lambda t: E.pricing_profile(t.panel, gated(t)),
      """WITH s AS (SELECT product_name, STDDEV_SAMP(mean_qty) / AVG(mean_qty) AS cv FROM month_means GROUP BY 1),
              p AS (SELECT product_name, AVG(sales_qty) FILTER (promotion = 1) AS a, AVG(sales_qty) FILTER (promotion = 0) AS b FROM panel GROUP BY 1)
         SELECT product_name, LEAST(1.0, COALESCE(cv, 0.5) * 2) AS seasonality, LEAST(1.0, COALESCE(ABS((a - b) / ((a + b) / 2)), 0.3) * 2) AS promotions,
                CASE WHEN elasticity < 0 THEN LEAST(1.0, ABS(elasticity) / 2) ELSE 0.5 END AS demand_sensitivity, 0.5 AS profit_margin, 0.5 AS model_confidence
         FROM s JOIN p USING (product_name) JOIN elas USING (product_name)""")

query("pricing_insights", "product_name, classification, advice, revenue_gain:3", lambda t: E.pricing_insights(t.panel, gated(t)),
      """WITH c AS (SELECT *, CASE WHEN elasticity < -1 THEN 'Elastic' WHEN elasticity < 0 THEN 'Inelastic' ELSE 'Neutral' END AS classification FROM pbase)
         SELECT product_name, classification, CASE classification WHEN 'Elastic' THEN 'Keep prices competitive' WHEN 'Inelastic' THEN 'Prices can rise by up to 8%' ELSE 'Decide on position and stock' END AS advice,
                CASE WHEN classification = 'Inelastic' THEN avg_price * 1.03 * (avg_qty * POW(1.03, elasticity)) - avg_price * avg_qty END AS revenue_gain FROM c""")

CTES["recs_now"] = "SELECT product_name, current_price AS latest_price, opt_price, opt_revenue, optimal_zone, opt_price - current_price AS price_change FROM zones"
query("current_recommendations", "product_name, latest_price:9, opt_price:6, opt_revenue:3, optimal_zone, price_change:6",
      lambda t: E.current_recommendations(t.panel, zones(t)), "SELECT * FROM recs_now")
query("recommendation_summary", "products:i, increases:i, decreases:i, projected_revenue:2",
      lambda t: E.recommendation_summary(E.current_recommendations(t.panel, zones(t))),
      """SELECT COUNT(*) AS products, COUNT(*) FILTER (price_change > 0) AS increases, COUNT(*) FILTER (price_change < 0) AS decreases, SUM(opt_revenue) AS projected_revenue FROM recs_now""")
query("revenue_impact", "revenue_gain:2, products:i", lambda t: E.revenue_impact(zones(t)),
      "SELECT SUM(base_revenue * (revenue_gain_pct / 100)) AS revenue_gain, COUNT(*) AS products FROM zones")
query("portfolio_elasticity", "mean_elasticity:6, note", lambda t: E.portfolio_elasticity(gated(t)),
      "SELECT m AS mean_elasticity, CASE WHEN m < -1 THEN 'price-elastic' WHEN m > -1 THEN 'price-inelastic' ELSE 'mixed' END AS note FROM (SELECT AVG(elasticity) AS m FROM elas)")

query("price_simulation_profit", "product_name, new_price:6, demand_change_pct:6, new_qty:6, new_revenue:3, new_profit:3, current_profit:3, profit_change:3, profit_change_pct:6",
      lambda t: E.price_simulation_profit(t.panel, gated(t), 5.0, 0.5, 1.0),
      """WITH d AS (SELECT *, current_price * 1.05 AS new_price, current_price * 0.5 AS cost, elasticity * 5 + 10 AS demand_change_pct FROM pbase),
              q AS (SELECT *, avg_qty * (1 + demand_change_pct / 100) AS new_qty, (current_price - cost) * avg_qty AS current_profit FROM d),
              r AS (SELECT *, new_price * new_qty AS new_revenue, (new_price - cost) * new_qty AS new_profit FROM q)
         SELECT *, new_profit - current_profit AS profit_change, (new_profit - current_profit) / current_profit * 100 AS profit_change_pct FROM r""")

# ---- price tests

CTES["tests"] = """
WITH a AS (SELECT product_name, MIN(price) AS lo, MAX(price) AS hi FROM panel GROUP BY 1)
SELECT product_name AS product_id, LEAST(9, FLOOR((price - lo) / ((hi - lo) / 10))) AS price, CAST(floor(price * sales_qty * 100 + 0.5) AS BIGINT) AS cents, 0 AS control_price, sales_qty AS demand, week_start
FROM panel JOIN a USING (product_name)"""


def price_tests(t):
    """Panel rows as price tests: the price is the index of one of ten equal bands, band 0 is the control."""
    lo, hi = F.min("price").over(by()), F.max("price").over(by())
    rows = t.panel.withColumns({"lo": lo, "hi": hi})
    band = F.least(F.lit(9), F.floor((F.col("price") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 10)))
    cents = F.floor(F.col("price") * F.col("sales_qty") * 100 + 0.5)  # exact sums, whatever their order
    return rows.select(
        F.col(KEY).alias("product_id"), (cents.cast("decimal(18,0)") * F.lit(Decimal("0.01"))).alias("revenue"),
        F.lit(0).cast("bigint").alias("control_price"), F.col("sales_qty").alias("demand"), TIME, band.alias("price"),
    )


query("ab_test", "product_id, sample_size:i, control_price:i, control_revenue:6, variants:i, best_revenue:6, winner:i, status",
      lambda t: A.ab_test(price_tests(t)),
      """WITH g AS (SELECT product_id, price, SUM(cents) / CAST(100 AS DOUBLE) / COUNT(*) AS m, COUNT(*) AS n FROM tests GROUP BY 1, 2),
              v AS (SELECT product_id, price, m, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY m DESC, price) AS rn FROM g WHERE price <> 0),
              s AS (SELECT product_id, SUM(n) AS sample_size, MAX(m) FILTER (price = 0) AS control_revenue, COUNT(*) FILTER (price <> 0) AS variants FROM g GROUP BY 1)
         SELECT s.*, 0 AS control_price, v.m AS best_revenue, CASE WHEN sample_size < 2 THEN NULL ELSE COALESCE(v.price, 0) END AS winner,
                CASE WHEN sample_size < 2 THEN 'Insufficient data' ELSE 'ok' END AS status FROM s LEFT JOIN v ON s.product_id = v.product_id AND v.rn = 1""")

# ---- strategies

# an uploaded product table whose numbers arrive as text, some of it unusable
CTES["raw_products"] = """
SELECT product_name || '_' || week_start AS product_id, CASE WHEN promotion = 1 AND holiday_flag = 1 THEN 'tbd' ELSE CAST(CAST(FLOOR(price * 100) AS BIGINT) AS VARCHAR) END AS price_text,
       CASE WHEN availability = 0 THEN '' ELSE CAST(CAST(stock_on_hand AS BIGINT) AS VARCHAR) END AS stock_text,
       CASE WHEN holiday_flag = 1 THEN NULL ELSE sales_qty END AS demand, CASE WHEN promotion = 1 THEN category END AS dept FROM panel"""


def raw_products(t):
    return t.panel.select(
        F.concat_ws("_", KEY, F.col(TIME).cast("string")).alias("product_id"),
        F.when((F.col("promotion") == 1) & (F.col("holiday_flag") == 1), "tbd")
        .otherwise(F.floor(F.col("price") * 100).cast("bigint").cast("string")).alias("price_text"),
        F.when(F.col("availability") == 0, "").otherwise(F.col("stock_on_hand").cast("bigint").cast("string")).alias("stock_text"),
        F.when(F.col("holiday_flag") != 1, F.col("sales_qty")).alias("demand"),
        F.when(F.col("promotion") == 1, F.col("category")).alias("dept"),
    )


query("product_context", "product_id, current_price:6, base_cost:6, current_stock:i, demand_forecast, competitor_price:6, category, market_share:2, seasonality_index:2, brand_loyalty_score:2, hour_of_day:i",
      lambda t: S.product_context(raw_products(t), {"product_id": "product_id", "current_price": "price_text", "current_stock": "stock_text", "demand_forecast": "demand", "category": "dept"}),
      """WITH p AS (SELECT *, COALESCE(TRY_CAST(price_text AS DOUBLE), 10) AS current_price FROM raw_products)
         SELECT product_id, current_price, current_price * 0.65 AS base_cost, COALESCE(TRY_CAST(stock_text AS DOUBLE), 100) AS current_stock, COALESCE(demand, 50) AS demand_forecast,
                current_price * 0.95 AS competitor_price, COALESCE(dept, 'general') AS category, 0 AS market_share, 1 AS seasonality_index, 0.5 AS brand_loyalty_score, 12 AS hour_of_day FROM p""")

CTES["ctx"] = """
WITH l AS (SELECT *, DAY(week_start) AS dom FROM panel),
     c AS (SELECT category, SUM(CAST(floor(price * 1e6 + 0.5) AS BIGINT)) / 1e6 / COUNT(*) AS cp, SUM(sales_qty) AS cq FROM panel GROUP BY 1),
     p AS (SELECT product_name, AVG(sales_qty) AS mq, SUM(sales_qty) AS tq FROM panel GROUP BY 1)
SELECT product_name || '_' || week_start AS product_id, price AS current_price, 0.65 * price AS base_cost, stock_on_hand AS current_stock, sales_qty AS demand_forecast, cp AS competitor_price,
       CASE category WHEN 'CAT0' THEN 'luxury' WHEN 'CAT1' THEN 'necessity' WHEN 'CAT2' THEN 'general' WHEN 'CAT3' THEN 'discretionary' ELSE 'commodity' END AS category,
       LEAST(1.3, GREATEST(0.8, sales_qty / mq)) AS seasonality_index, 2 * tq / cq AS market_share, 1.0 AS price_sensitivity_score, CASE WHEN dom % 3 = 0 THEN 0.8 ELSE 0.5 END AS brand_loyalty_score,
       CASE WHEN dom % 2 = 1 THEN dom % 7 END AS days_until_expiry, promotion = 1 AS is_promotion, CASE WHEN dom % 4 = 0 THEN 2 ELSE 0 END AS cross_n, dom % 5 = 0 AS own_segments,
       dom % 2 = 0 AS is_weekend, holiday_flag = 1 AS is_holiday, 12 + dom % 10 AS hour_of_day, CASE WHEN promotion = 0 THEN floor(elasticity * 1e9 + 0.5) / 1e9 END AS elasticity_estimate
FROM l JOIN c USING (category) JOIN p USING (product_name) JOIN elas_simple USING (product_name)"""


def contexts(t):
    """Every week of every product as a pricing context."""
    weeks = t.panel.select(KEY, TIME, "category", "price", "stock_on_hand", "sales_qty", "promotion", "holiday_flag")
    micro = F.sum(F.floor(F.col("price") * F.lit(1e6) + F.lit(0.5)))  # a whole number: the mean does not depend on the order of the rows
    cat = t.panel.groupBy("category").agg((micro / F.lit(1e6) / F.count(F.lit(1))).alias("cp"), F.sum("sales_qty").alias("cq"))
    prod = t.panel.groupBy(KEY).agg(F.avg("sales_qty").alias("mq"), F.sum("sales_qty").alias("tq"))
    est = E.elasticity_simple(t.panel).select(KEY, F.col("elasticity").alias("est"))
    rows = sized_join(weeks, cat, "category", "inner").join(prod, KEY).join(est, KEY)
    dom = F.day(TIME)
    names = F.when(F.col("category") == "CAT0", "luxury").when(F.col("category") == "CAT1", "necessity").when(
        F.col("category") == "CAT2", "general").when(F.col("category") == "CAT3", "discretionary").otherwise("commodity")
    return rows.select(
        F.concat_ws("_", KEY, F.col(TIME).cast("string")).alias("product_id"),
        F.col("price").alias("current_price"), (F.lit(0.65) * F.col("price")).alias("base_cost"),
        F.col("stock_on_hand").alias("current_stock"), F.col("sales_qty").alias("demand_forecast"),
        F.col("cp").alias("competitor_price"), names.alias("category"),
        F.least(F.lit(1.3), F.greatest(F.lit(0.8), F.col("sales_qty") / F.col("mq"))).alias("seasonality_index"),
        (2 * F.col("tq") / F.col("cq")).alias("market_share"), F.lit(1.0).alias("price_sensitivity_score"),
        F.when(dom % 3 == 0, 0.8).otherwise(0.5).alias("brand_loyalty_score"),
        F.when(dom % 2 == 1, dom % 7).alias("days_until_expiry"), (F.col("promotion") == 1).alias("is_promotion"),
        F.when(dom % 4 == 0, F.array("category", KEY)).otherwise(F.array().cast("array<string>")).alias("cross_sell_products"),
        F.when(dom % 5 == 0, F.create_map(F.lit("vip"), F.lit(1.3), F.lit("basic"), F.lit(0.9))).alias("customer_segments"),
        F.weekday(TIME).alias("day_of_week"), (dom % 2 == 0).alias("is_weekend"), (F.col("holiday_flag") == 1).alias("is_holiday"),
        (12 + dom % 10).alias("hour_of_day"), F.when(F.col("promotion") == 0, places("est", 9)).alias("elasticity_estimate"),
    )


CTES["ctxe"] = """
WITH b AS (SELECT *, CASE category WHEN 'luxury' THEN -0.8 WHEN 'necessity' THEN -0.5 WHEN 'general' THEN -1.5 WHEN 'discretionary' THEN -2.0 ELSE -2.5 END * price_sensitivity_score AS e0 FROM ctx)
SELECT *, CASE WHEN elasticity_estimate IS NOT NULL THEN 0.7 * e0 + 0.3 * elasticity_estimate ELSE e0 END * (CASE WHEN is_promotion THEN 1.3 ELSE 1.0 END)
       * (CASE WHEN brand_loyalty_score > 0.7 THEN 0.8 ELSE 1.0 END) AS elasticity, base_cost * 1.1 AS lo, current_price * 1.5 AS hi FROM b"""
query("strategy_elasticity_prior", "product_id, elasticity:6", lambda t: S.strategy_elasticity_prior(contexts(t)), "SELECT * FROM ctxe")

AT = "demand_forecast * POW({p} / current_price, elasticity)"


def six(c):
    return f"floor({c} * 1e6 + 0.5e0) / 1e6"


def rec_sql(name, src, demand=AT.format(p="p"), risk=None):
    """Recommendation columns over a source that adds the price p to the contexts."""
    level = "'Medium'" if risk is None else f"CASE WHEN ABS((p - current_price) / current_price) > {risk[1]} THEN 'High' WHEN ABS((p - current_price) / current_price) > {risk[0]} THEN 'Medium' ELSE 'Low' END"
    return f"""SELECT product_id, current_price, base_cost, demand_forecast, p AS recommended_price, d AS expected_demand, p * d AS expected_revenue, (p - base_cost) * d AS expected_profit,
        LEAST(1.0, d / (demand_forecast * 1.5)) AS expected_market_share, {S.CONFIDENCE[name]} AS confidence_score, '{name}' AS strategy_used, {level} AS risk_assessment
        FROM (SELECT * EXCLUDE (d0), {six('d0')} AS d FROM (SELECT *, {demand} AS d0 FROM (SELECT * REPLACE ({six('p')} AS p) FROM ({src}))))"""


def best_sql(src, score, prices):
    """`src` with the price of the highest score, the first on ties, as p; `prices` is a list of expressions."""
    points = "[" + ", ".join(f"CAST({p} AS DOUBLE)" for p in prices) + "]"
    return f"""SELECT * EXCLUDE (q, i, s) REPLACE (q AS p) FROM (SELECT *, {score} AS s FROM (SELECT *, unnest({points}) AS q, unnest(range({len(prices)})) AS i FROM ({src})))
               QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY s DESC, i) = 1"""


def narrowed_sql(score, kinks):
    """The narrowing grids and the parabola, from their definition; `score` is an expression of q."""
    sql = best_sql("SELECT *, 0.0e0 AS p FROM ctxe", score, [f"lo + (hi - lo) * {i / S.COARSE}e0" for i in range(S.COARSE + 1)])
    for r in range(1, S.ROUNDS + 1):
        step = f"(hi - lo) / {S.COARSE * S.FINE**r}"
        sql = best_sql(sql, score, [f"LEAST(GREATEST(p + {step} * {k}, lo), hi)" for k in range(1 - S.FINE, S.FINE)])
    step = f"((hi - lo) / {S.COARSE * S.FINE**S.ROUNDS})"
    sql = f"SELECT *, p - {step} AS p0, p AS p1, p + {step} AS p2 FROM ({sql})"
    for k in range(3):
        sql = f"SELECT * EXCLUDE (q), {score} AS y{k} FROM (SELECT *, p{k} AS q FROM ({sql}))"
    sql = f"""SELECT * EXCLUDE (p0, p1, p2, y0, y1, y2) REPLACE (CASE WHEN y1 >= y0 AND y1 >= y2 AND y0 - 2 * y1 + y2 < 0 AND p0 >= lo AND p2 <= hi
              THEN p - {step} / 2 * ((y2 - y0) / (y0 - 2 * y1 + y2)) ELSE p END AS p) FROM ({sql})"""
    sql = best_sql(sql, score, ["p", *[f"CASE WHEN {k} > lo AND {k} < hi THEN {k} ELSE p END" for k in kinks]])
    return f"SELECT * REPLACE (floor(p * 1e4 + 0.5e0) / 1e4 AS p) FROM ({sql})"


DEMAND = "demand_forecast * POW(q / current_price, elasticity)"
CTES["r_rule"] = rec_sql("rule_based", """
  WITH a AS (SELECT *, demand_forecast / GREATEST(current_stock, 1.0) AS v, CASE WHEN competitor_price > 0 THEN (current_price - competitor_price) / competitor_price END AS gap FROM ctxe),
       b AS (SELECT *, current_price * (1 + CASE WHEN v < 0.3 THEN -LEAST(0.25, (0.3 - v) * 0.5) WHEN v > 0.8 THEN LEAST(0.20, (v - 0.8) * 0.3) ELSE 0 END)
                * (CASE WHEN is_weekend THEN 1.05 ELSE 1.0 END * CASE WHEN is_holiday THEN 1.10 ELSE 1.0 END * CASE WHEN hour_of_day BETWEEN 18 AND 21 THEN 1.03 ELSE 1.0 END) * seasonality_index AS p0 FROM a),
       c AS (SELECT *, CASE WHEN gap > 0.10 AND market_share < 0.3 THEN competitor_price * 0.98 WHEN gap < -0.05 AND market_share > 0.4 THEN competitor_price * 1.05 ELSE p0 END AS p1 FROM b),
       d AS (SELECT *, p1 * (1 + CASE WHEN brand_loyalty_score > 0.7 THEN 0.05 * brand_loyalty_score ELSE 0 END)
                * (1 - CASE WHEN days_until_expiry <= 1 THEN 0.40 WHEN days_until_expiry <= 2 THEN 0.25 WHEN days_until_expiry <= 4 THEN 0.15 ELSE 0 END) * (1 - LEAST(0.10, cross_n * 0.03)) AS p2 FROM c)
  SELECT *, LEAST(GREATEST(p2, GREATEST(lo, current_price * 0.6)), hi) AS p FROM d""",
    "demand_forecast * GREATEST(0, 1 - (p - current_price) / current_price * 0.5)", (0.1, 0.2))
CTES["r_elas"] = rec_sql("elasticity", "SELECT *, LEAST(GREATEST(CASE WHEN elasticity < -1 THEN base_cost * elasticity / (1 + elasticity) ELSE hi END, lo), hi) AS p FROM ctxe", risk=(0.1, 0.2))
_final = f"({DEMAND} * seasonality_index * (0.7 + 0.3 * EXP(-2 * ABS(q - competitor_price) / competitor_price)))"
CTES["r_opt"] = rec_sql("optimization", narrowed_sql(
    f"""0.6 * ((q - base_cost) * {_final}) + 0.3 * (q * {_final}) + 0.1 * ({_final} / (demand_forecast * 1.5 + 1e-6)) * 1000
        - (POW(GREATEST({_final} - current_stock, 0), 2) * 10 + POW(GREATEST(lo - q, 0), 2) * 100)""", ["competitor_price"]), AT.format(p="p") + " * seasonality_index")
_b = "(0.5 * base_cost - 2000 / (demand_forecast * 1.2 + 1e-6))"
CTES["r_multi"] = rec_sql("multi_objective", best_sql(
    "SELECT *, 0.0e0 AS p FROM ctxe", f"0.5 * ((q - base_cost) * {DEMAND}) + 0.3 * (q * {DEMAND}) + 0.2 * ({DEMAND} / (demand_forecast * 1.2 + 1e-6)) * 10000",
    ["lo", "hi", f"CASE WHEN elasticity <> -1 THEN LEAST(GREATEST(elasticity * {_b} / (0.8 * (1 + elasticity)), lo), hi) ELSE lo END"]))
CTES["r_seg"] = rec_sql("customer_segmentation", "SELECT *, CASE WHEN own_segments THEN (current_price * 1.3 + current_price * 0.9) / 2 ELSE (current_price * 1.2 + current_price + current_price * 0.8) / 3 END AS p FROM ctxe")

STATE_SQL = """CASE WHEN stock > qty * 2 THEN 'high' WHEN stock > qty THEN 'medium' ELSE 'low' END || '_' || CASE WHEN qty > stock * 0.7 THEN 'high' WHEN qty > stock * 0.3 THEN 'medium' ELSE 'low' END
  || '_' || CASE WHEN price > cp THEN 'above' WHEN ABS(price - cp) < 0.5 THEN 'at' ELSE 'below' END"""
CTES["qtable"] = f"""
WITH h AS (SELECT stock_on_hand AS stock, sales_qty AS qty, price, cp, price / LAG(price) OVER (PARTITION BY product_name ORDER BY week_start) - 1 AS dp
           FROM panel JOIN (SELECT category, AVG(price) AS cp FROM panel GROUP BY 1) USING (category))
SELECT {STATE_SQL} AS state, GREATEST(0, LEAST(6, ROUND(dp / 0.05) + 3)) AS step, AVG(price * qty / 1000.0) AS value FROM h WHERE dp IS NOT NULL GROUP BY 1, 2"""
CTES["r_state"] = rec_sql("reinforcement_learning", f"""
  WITH s AS (SELECT *, {STATE_SQL.replace('stock', 'current_stock').replace('qty', 'demand_forecast').replace('price', 'current_price').replace('cp', 'competitor_price')} AS state FROM ctxe),
       a AS (SELECT s.*, i, COALESCE(q.value, 0) AS v FROM s CROSS JOIN range(7) r(i) LEFT JOIN qtable q ON q.state = s.state AND q.step = i),
       b AS (SELECT * FROM a QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY v DESC, i) = 1)
  SELECT *, LEAST(GREATEST(current_price * (1 + (i - 3) * 0.05), lo), hi) AS p FROM b""")
CTES["arms"] = """
  WITH h AS (SELECT product_name, week_start, price, sales_qty, NTILE(10) OVER (PARTITION BY product_name ORDER BY price, week_start) - 1 AS arm,
               AVG(sales_qty) OVER (PARTITION BY product_name ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS expected FROM panel)
  SELECT *, MIN(price) OVER (PARTITION BY product_name, arm) AS arm_price, price * sales_qty > price * expected * 0.8e0 AS won FROM h"""
CTES["r_bandit"] = rec_sql("multi_armed_bandit", """
  WITH t AS (SELECT DISTINCT product_name, arm AS i, arm_price AS ip FROM arms),
       c AS (SELECT a.product_name, week_start, i, ip, CASE WHEN arm = i AND won THEN 1 ELSE 0 END AS win, CASE WHEN arm = i AND NOT won THEN 1 ELSE 0 END AS loss FROM arms a JOIN t USING (product_name)),
       s AS (SELECT product_name || '_' || week_start AS product_id, i AS arm, ip AS arm_price, COALESCE(SUM(win) OVER past, 0) AS wins, COALESCE(SUM(loss) OVER past, 0) AS losses FROM c
             WINDOW past AS (PARTITION BY product_name, i ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
       w AS (SELECT product_id, arm_price FROM s JOIN ctxe USING (product_id) WHERE arm_price BETWEEN lo AND hi
             QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY (wins + 1) / (wins + losses + 2) DESC, arm) = 1)
  SELECT ctxe.*, LEAST(GREATEST(COALESCE(arm_price, current_price), lo), hi) AS p FROM ctxe LEFT JOIN w USING (product_id)""")
for _name in ("ctx", "ctxe", "r_rule", "r_elas", "r_opt", "r_multi", "r_seg", "qtable", "r_state", "r_bandit"):
    # plain decimals are exact in SQL but doubles in the operators
    CTES[_name] = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", CTES[_name])


def history(t):
    """Past weeks as contexts with the price change and the revenue they saw."""
    cat = t.panel.groupBy("category").agg(F.avg("price").alias("competitor_price"))
    return sized_join(t.panel.withColumn("price_change", change("price")), cat, "category", "inner").select(
        F.col("stock_on_hand").alias("current_stock"), F.col("sales_qty").alias("demand_forecast"),
        F.col("price").alias("current_price"), "competitor_price", "price_change",
        (F.col("price") * F.col("sales_qty")).alias("revenue"),
    )


def sales_history(t):
    """Weeks with their revenue and the one expected from the mean quantity of the four weeks before."""
    past = F.avg("sales_qty").over(rows(-4, -1))
    return t.panel.select(
        KEY, TIME, F.col("price").alias("sold_price"), (F.col("price") * F.col("sales_qty")).alias("sold_revenue"), (F.col("price") * past).alias("expected_revenue"),
    )


def arms(t):
    """Arm results of every week of every product, by context."""
    found = S.arm_results(sales_history(t), KEY, TIME)
    return found.withColumn("product_id", F.concat_ws("_", KEY, F.col(TIME).cast("string")))


STRATEGIES = {
    "strategy_rule_based": (lambda t: S.strategy_rule_based(contexts(t)), "r_rule"),
    "strategy_elasticity": (lambda t: S.strategy_elasticity(contexts(t)), "r_elas"),
    "strategy_optimization": (lambda t: S.strategy_optimization(contexts(t)), "r_opt"),
    "strategy_multi_objective": (lambda t: S.strategy_multi_objective(contexts(t)), "r_multi"),
    "strategy_segments": (lambda t: S.strategy_segments(contexts(t)), "r_seg"),
    "strategy_state_action": (lambda t: S.strategy_state_action(contexts(t), S.learned_steps(history(t)), eps=0.0), "r_state"),
    "strategy_bandit": (lambda t: S.strategy_bandit(contexts(t), arms(t)), "r_bandit"),
}
REC = "product_id, current_price:6, recommended_price:6, expected_demand:6, expected_revenue:6, expected_profit:6, expected_market_share:6, confidence_score:2, strategy_used, risk_assessment"
for _name, (_build, _view) in STRATEGIES.items():
    query(_name, REC, _build, f"SELECT * FROM {_view}")

# draws are seeded but have no SQL twin; the exploring mode likewise
query("strategy_bandit_draw", REC, lambda t: S.strategy_bandit(contexts(t), arms(t), draw=True))
query("strategy_state_action_explore", REC, lambda t: S.strategy_state_action(contexts(t), S.learned_steps(history(t)), eps=0.1))


def members(t):
    """Member strategies by name: price expressions, and functions of the context rows."""
    table, results = S.learned_steps(history(t)), arms(t)
    return {
        "rule_based": S.rule_price(), "elasticity": S.elasticity_price(), "optimization": lambda df: S.optimization_price(df, "recommended_price"),
        "multi_objective": S.multi_objective_price(), "customer_segmentation": S.segments_price(),
        "reinforcement_learning": lambda df: S.strategy_state_action(df, table, eps=0.0),
        "multi_armed_bandit": lambda df: S.strategy_bandit(df, results),
    }


CTES["r_all"] = " UNION ALL ".join(f"SELECT product_id, recommended_price, confidence_score, strategy_used FROM {v}" for _, v in STRATEGIES.values())
_wt = "CASE strategy_used " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.WEIGHTS.items()) + " END"
CTES["r_ens"] = rec_sql("ensemble", f"""SELECT ctxe.*, p FROM ctxe JOIN (SELECT product_id, SUM(recommended_price * ({_wt} * confidence_score)) / (SUM({_wt} * confidence_score) + 1e-9) AS p
    FROM r_all GROUP BY 1) USING (product_id)""", "GREATEST(0, " + AT.format(p="p") + ")", (0.12, 0.25))


def ensemble(t):
    ctx = written(contexts(t), "contexts")  # read by the members and by the arm results
    return S.strategy_ensemble(ctx, members(t))


query("strategy_ensemble", REC, ensemble, "SELECT * FROM r_ens")
query("batch_pricing", "product_id, current_price:9, recommended_price:6, change_pct:6, expected_demand:6, expected_revenue:6, expected_profit:6, confidence_score:2, risk_assessment, strategy_used, top_features",
      lambda t: S.batch_pricing(ensemble(t)),
      "SELECT *, (recommended_price - current_price) / current_price * 100 AS change_pct, 'ensemble_diversity' AS top_features FROM r_ens")
query("pricing_report", "products:i, avg_price_change:6, revenue_lift:6, profit_lift:6, avg_confidence:6, risk_low:i, risk_medium:i, risk_high:i, top_opportunities",
      lambda t: S.pricing_report(ensemble(t)),
      """WITH g AS (SELECT product_id, expected_profit - (current_price - base_cost) * demand_forecast AS gain FROM r_ens)
         SELECT COUNT(*) AS products, AVG((recommended_price - current_price) / current_price) * 100 AS avg_price_change,
                (SUM(expected_revenue) - SUM(current_price * demand_forecast)) / GREATEST(1.0, SUM(current_price * demand_forecast)) * 100 AS revenue_lift,
                (SUM(expected_profit) - SUM((current_price - base_cost) * demand_forecast)) / GREATEST(1.0, SUM((current_price - base_cost) * demand_forecast)) * 100 AS profit_lift,
                AVG(confidence_score) * 100 AS avg_confidence, COUNT(*) FILTER (risk_assessment = 'Low') AS risk_low, COUNT(*) FILTER (risk_assessment = 'Medium') AS risk_medium,
                COUNT(*) FILTER (risk_assessment = 'High') AS risk_high,
                (SELECT STRING_AGG(product_id, ', ' ORDER BY gain DESC, product_id) FROM (SELECT * FROM g ORDER BY gain DESC, product_id LIMIT 10)) AS top_opportunities FROM r_ens""")
