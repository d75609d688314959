"""Anomaly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY, TIME, rows
from shelfspark.operators import aggregates as A
from shelfspark.operators import anomaly as N
from shelfspark.operators import filters as P
from shelfspark.operators.windows import zscore_product
from shelfspark.plans.registry import CTES, query

_w = "PARTITION BY product_name ORDER BY week_start"


def _cent(k):
    fr = f"({_w} ROWS BETWEEN {k // 2} PRECEDING AND {(k - 1) // 2} FOLLOWING)"
    return f"WHEN {k} THEN CASE WHEN COUNT(*) OVER {fr} = {k} THEN AVG(sales_qty) OVER {fr} END"


CTES["scored"] = f"""
WITH a AS (SELECT *, COUNT(*) OVER p AS n, AVG(sales_qty) OVER p AS mean, STDDEV_SAMP(sales_qty) OVER p AS std, QUANTILE_CONT(sales_qty, 0.25) OVER p AS q1,
                  QUANTILE_CONT(sales_qty, 0.75) OVER p AS q3 FROM panel WINDOW p AS (PARTITION BY product_name)),
     b AS (SELECT *, CASE LEAST(8, n // 2) {' '.join(_cent(k) for k in (5, 6, 7, 8))} END AS raw FROM a WHERE n >= 10),
     c AS (SELECT *, COALESCE(LAST_VALUE(raw IGNORE NULLS) OVER ({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                              FIRST_VALUE(raw IGNORE NULLS) OVER ({_w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS expected_sales FROM b)
SELECT *, ABS((sales_qty - mean) / (std + 1e-6)) > CASE WHEN std / (mean + 1e-6) < 0.3 THEN 2.5 WHEN std / (mean + 1e-6) < 0.5 THEN 2.0 ELSE 1.5 END AS z_flag,
       sales_qty < q1 - 1.5 * (q3 - q1) OR sales_qty > q3 + 1.5 * (q3 - q1) AS iqr_flag, (sales_qty - expected_sales) / (expected_sales + 1e-6) * 100 AS deviation_pct FROM c"""
CTES["anoms"] = f"""
SELECT product_name, week_start AS date, sales_qty AS actual_sales, expected_sales, deviation_pct,
       CASE WHEN ABS(deviation_pct) > 50 THEN 'Severe' WHEN ABS(deviation_pct) > 25 THEN 'Moderate' WHEN ABS(deviation_pct) > 10 THEN 'Mild' ELSE 'Normal' END AS severity,
       CASE WHEN ABS(deviation_pct) > 50 THEN '{N.ACTIONS['URGENT']}' WHEN deviation_pct > 30 THEN '{N.ACTIONS['SPIKE']}' WHEN deviation_pct < -30 THEN '{N.ACTIONS['DROP']}'
            ELSE '{N.ACTIONS['NONE']}' END AS suggested_action, 60 AS confidence
FROM scored WHERE z_flag AND iqr_flag"""


def anoms(t):
    return N.anomaly_hybrid(t.panel)


AN = "product_name, date:d, actual_sales, expected_sales:6, deviation_pct:6, severity, suggested_action, confidence:2"
query("anomaly_hybrid", AN, anoms, "SELECT * FROM anoms")

CH = "type, product_name, category, date:d, actual_sales, normal_sales:6, change_pct:6, possible_reason, recommended_action"
_none = {"type": "NONE", KEY: "N/A", "category": "N/A", "actual_sales": 0.0, "normal_sales": 0.0, "change_pct": 0.0,
         "possible_reason": "No anomalies detected", "recommended_action": "No action required"}


def _change_sql(src, normal, reason, action):
    return f"""SELECT CASE WHEN sales_qty > {normal} THEN 'SALES SPIKE' ELSE 'SALES DROP' END AS type, product_name, category, week_start AS date, sales_qty AS actual_sales, {normal} AS normal_sales,
        ABS((sales_qty - {normal}) / {normal} * 100) AS change_pct, {reason} AS possible_reason, '{action}' AS recommended_action FROM {src} WHERE {normal} > 0"""


def _sigma(k, width):
    return f"""WITH m AS (SELECT *, COUNT(*) OVER (PARTITION BY product_name) AS n, CASE WHEN COUNT(*) OVER f = {width} THEN AVG(sales_qty) OVER f END AS ma, CASE WHEN COUNT(*) OVER f = {width} THEN STDDEV_SAMP(sales_qty) OVER f END AS sd
                FROM panel WINDOW f AS ({_w} ROWS {width - 1} PRECEDING)),
        o AS (SELECT * FROM m WHERE n >= 8 AND ABS(sales_qty - ma) > {k} * sd QUALIFY ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY week_start DESC) <= 2)"""


_body = _change_sql("o", "ma", "'Statistical anomaly detected'", "Review and investigate cause")
# four-row windows that include the row cannot pass two deviations, so this gives the placeholder row
query("anomaly_rolling_2sigma", CH, lambda t: A.union_placeholder(N.anomaly_rolling_2sigma(t.panel), _none),
      f"{_sigma(2, 4)}, r AS ({_body}) SELECT * FROM r UNION ALL SELECT 'NONE', 'N/A', 'N/A', NULL, 0, 0, 0, 'No anomalies detected', 'No action required' WHERE NOT EXISTS (SELECT 1 FROM r)")
query("anomaly_rolling_12_weeks", CH, lambda t: N.anomaly_rolling_2sigma(t.panel, 12), f"{_sigma(2, 12)} {_body}")

# stand-in detector flags: -1 where the product's z-score passes 1.5
CTES["flags"] = """SELECT product_name, week_start, CASE WHEN ABS((sales_qty - AVG(sales_qty) OVER p) / (STDDEV_SAMP(sales_qty) OVER p + 1e-6)) > 1.5 THEN -1 ELSE 1 END AS flag
FROM panel WINDOW p AS (PARTITION BY product_name)"""


def flags(t):
    return zscore_product(t.panel, "sales_qty").select(KEY, TIME, F.when(F.abs("z_score") > 1.5, -1).otherwise(1).alias("flag"))


query("anomaly_recent_flagged", CH, lambda t: N.anomaly_recent_flagged(t.panel, flags(t)),
      """WITH j AS (SELECT panel.*, flag, AVG(sales_qty) FILTER (flag = 1) OVER (PARTITION BY product_name) AS normal FROM panel JOIN flags USING (product_name, week_start)),
              r AS (SELECT * FROM j WHERE flag = -1 AND week_start >= (SELECT MAX(week_start) FROM panel) - 28) """
      + _change_sql("r", "normal", "CASE WHEN sales_qty > normal THEN 'Promotion/Market factors' ELSE 'Competition/Quality issue' END", "Investigate and adjust inventory planning"))

query("anomaly_listing", "product_name, category, week_start:d, sales_qty, action", lambda t: N.anomaly_listing(t.panel, flags(t)),
      "SELECT product_name, category, week_start, sales_qty, 'Investigate anomaly' AS action FROM panel JOIN flags USING (product_name, week_start) WHERE flag = -1")

CTES["fitted4"] = f"SELECT product_name, week_start, sales_qty, AVG(sales_qty) OVER ({_w} ROWS 3 PRECEDING) AS fitted FROM panel"


def fitted4(t):
    return t.panel.select(KEY, TIME, "sales_qty", F.avg("sales_qty").over(rows(-3, 0)).alias("fitted"))


query("residual_flags", "product_name, week_start:d, sales_qty, fitted:6, z:6", lambda t: N.residual_flags(fitted4(t), 2.5),
      """WITH r AS (SELECT *, sales_qty - fitted AS resid FROM fitted4),
              z AS (SELECT *, (resid - AVG(resid) OVER p) / CASE WHEN STDDEV_SAMP(resid) OVER p > 0 THEN STDDEV_SAMP(resid) OVER p ELSE 1 END AS z FROM r WINDOW p AS (PARTITION BY product_name))
         SELECT * FROM z WHERE ABS(z) >= 2.5""")
query("residual_flags_population", "product_name, week_start:d, sales_qty, fitted:6, z:6", lambda t: N.residual_flags(fitted4(t), 2.5, True),
      """WITH z AS (SELECT *, (sales_qty - fitted) / STDDEV_POP(sales_qty - fitted) OVER (PARTITION BY product_name) AS z FROM fitted4) SELECT * FROM z WHERE ABS(z) > 2.5""")

query("anomaly_sensitivity", AN, lambda t: N.anomaly_sensitivity(anoms(t), 50),
      """SELECT * FROM (SELECT *, 0.5 * QUANTILE_CONT(ABS(deviation_pct), 0.95) OVER (PARTITION BY product_name) AS cut FROM anoms)
         WHERE ABS(deviation_pct) >= cut AND severity IN ('Moderate', 'Severe')""")

query("anomaly_one_class", "product_name, week_start:d, distance:6, flag:i", lambda t: N.anomaly_one_class(t.panel, ["sales_qty", "price"]),
      """WITH m AS (SELECT AVG(sales_qty) AS ma, AVG(price) AS mb, STDDEV_SAMP(sales_qty) AS sa, STDDEV_SAMP(price) AS sb, CORR(sales_qty, price) AS r FROM panel),
              z AS (SELECT product_name, week_start, (sales_qty - ma) / sa AS a, (price - mb) / sb AS b, r FROM panel, m),
              d AS (SELECT *, (a * a - 2 * r * a * b + b * b) / (1 - r * r) AS distance FROM z)
         SELECT *, CASE WHEN distance > (SELECT QUANTILE_CONT(distance, 0.95) FROM d) THEN -1 ELSE 1 END AS flag FROM d""")

query("join_first_match", "product_name, date:d, deviation_pct:6, price:9, stock_on_hand, promotion:i, holiday_flag:i", lambda t: A.join_first_match(anoms(t), t.panel),
      "SELECT a.product_name, a.date, a.deviation_pct, p.price, p.stock_on_hand, p.promotion, p.holiday_flag FROM anoms a LEFT JOIN panel p ON a.product_name = p.product_name AND a.date = p.week_start")

query("join_anomaly_context", "product_name, n:i, price_corr:6, stock_corr:6", lambda t: A.join_anomaly_context(anoms(t), t.panel),
      """SELECT a.product_name, COUNT(*) AS n, CORR(deviation_pct, price) AS price_corr, CORR(deviation_pct, stock_on_hand) AS stock_corr FROM anoms a
         JOIN panel p ON a.product_name = p.product_name AND a.date = p.week_start GROUP BY 1 HAVING COUNT(*) > 3""")

query("anomaly_root_cause", "product_name, date:d, deviation_pct:6, likely_causes, cause_text, pattern_type, pattern, direction, actions, severity, confidence:2",
      lambda t: N.anomaly_root_cause(anoms(t), t.panel),
      f"""WITH j AS (SELECT a.*, p.price, p.stock_on_hand, p.promotion, p.holiday_flag, deviation_pct AS d FROM anoms a LEFT JOIN panel p ON a.product_name = p.product_name AND a.date = p.week_start),
               c AS (SELECT *, list_filter([CASE WHEN price IS NOT NULL AND d < -20 THEN 'increased pricing' WHEN price IS NOT NULL AND d > 20 THEN 'price reduction or promotion' END,
                     CASE WHEN stock_on_hand < 50 THEN 'low inventory levels' END, CASE WHEN promotion > 0 THEN 'active promotion campaign' END,
                     CASE WHEN holiday_flag > 0 THEN 'holiday period effect' END], lambda x: x IS NOT NULL) AS c0 FROM j),
               l AS (SELECT *, CASE WHEN len(c0) > 0 THEN c0 ELSE ['seasonal variation', 'market demand shift', 'external factors'] END AS cs FROM c),
               x AS (SELECT *, array_to_string(cs, ', ') AS likely_causes, array_to_string(cs[1:2], ' and ') AS cause_text FROM l)
          SELECT *, CASE WHEN contains(likely_causes, 'holiday') THEN 'spike before holidays' WHEN d < -20 THEN 'consistent weekly drops' WHEN contains(likely_causes, 'promotion') THEN 'promotional spikes'
                         ELSE 'significant sales variation' END AS pattern_type,
                 CASE WHEN d > 50 THEN 'major sales spike' WHEN d < -50 THEN 'severe sales drop' WHEN d > 25 THEN 'significant surge' WHEN d < -25 THEN 'notable decline' END AS pattern,
                 CASE WHEN d > 0 THEN 'surge' ELSE 'drop' END AS direction, CASE WHEN d < -30 THEN '{N.LOW_ACTIONS}' WHEN d > 30 THEN '{N.HIGH_ACTIONS}' ELSE '{N.CALM_ACTIONS}' END AS actions FROM x""")

query("anomaly_feed", "product_name, date:d, deviation_pct:6, severity, message", lambda t: N.anomaly_feed(anoms(t)),
      """SELECT *, CASE WHEN deviation_pct > 30 THEN 'spike due to promotional activity or demand surge' WHEN deviation_pct < -30 THEN 'drop likely due to supply constraints or pricing changes'
                        ELSE 'variation to monitor' END AS message FROM anoms ORDER BY ABS(deviation_pct) DESC, product_name, date LIMIT 6""")

CTES["anom_stats"] = """
WITH m AS (SELECT product_name, MONTH(date) AS mo, COUNT(*) AS c FROM anoms GROUP BY 1, 2),
     t AS (SELECT product_name, mo AS top_month FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY c DESC, mo) = 1)
SELECT product_name, COUNT(*) AS n, AVG(ABS(deviation_pct)) AS avg_deviation, MEDIAN(ABS(deviation_pct)) AS median_deviation, STDDEV_SAMP(deviation_pct) AS std_deviation,
       COUNT(*) FILTER (severity = 'Severe') AS severe, MAX(top_month) AS top_month, AVG(confidence) AS avg_confidence FROM anoms JOIN t USING (product_name) GROUP BY 1"""
query("anomaly_stats", "product_name, n:i, avg_deviation:6, median_deviation:6, std_deviation:6, severe:i, top_month:i, avg_confidence:6",
      lambda t: N.anomaly_stats(anoms(t)), "SELECT * FROM anom_stats")

query("anomaly_sign_pattern", "product_name, spikes:i, drops:i, pattern", lambda t: N.anomaly_sign_pattern(N.anomaly_hybrid(t.panel, iso=flags(t).withColumn("flag", (F.col("flag") == -1).cast("int")))),
      """WITH f AS (SELECT s.*, CASE WHEN flag = -1 THEN 3 ELSE 0 END + CASE WHEN z_flag THEN 3 ELSE 0 END + CASE WHEN iqr_flag THEN 3 ELSE 0 END AS score FROM scored s JOIN flags USING (product_name, week_start)),
              c AS (SELECT product_name, COUNT(*) FILTER (deviation_pct > 0) AS spikes, COUNT(*) FILTER (deviation_pct < 0) AS drops FROM f WHERE score >= 5 GROUP BY 1)
         SELECT *, CASE WHEN spikes > drops * 2 THEN 'Consistent spikes' WHEN drops > spikes * 2 THEN 'Consistent drops' ELSE 'Mixed variations' END AS pattern FROM c""")

query("anomaly_report", "product_name, line:i, anomalies:i, deviation:6, severe:i, confidence:6, date:d, severity", lambda t: N.anomaly_report(anoms(t)),
      """SELECT product_name, 0 AS line, n AS anomalies, avg_deviation AS deviation, severe, avg_confidence AS confidence, NULL AS date, NULL AS severity FROM anom_stats
         UNION ALL SELECT * FROM (SELECT product_name, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY ABS(deviation_pct) DESC, date) AS line, NULL, deviation_pct, NULL, confidence, date, severity FROM anoms) WHERE line <= 5""")

query("pivot_anomaly", "product_name, " + ", ".join(f"m{m}:6" for m in range(1, 13)), lambda t: A.pivot_anomaly(anoms(t)),
      "SELECT product_name, " + ", ".join(f"AVG(ABS(deviation_pct)) FILTER (MONTH(date) = {m}) AS m{m}" for m in range(1, 13)) + " FROM anoms GROUP BY 1")

query("filter_severity", "product_name, date:d, severity", lambda t: P.filter_isin(anoms(t), "severity", ["Severe", "Moderate"]),
      "SELECT product_name, date, severity FROM anoms WHERE severity IN ('Severe', 'Moderate')")
