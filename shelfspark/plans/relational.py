"""Filters, projections, joins, aggregates, pivots, top-k, unions and scalar groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY, TIME, ordered, stacked
from shelfspark.functions.stats import corr
from shelfspark.operators import aggregates as A
from shelfspark.operators import filters as P
from shelfspark.plans.registry import CTES, query

PANEL = "product_name, category:s, week_start:d, sales_qty, price, stock_on_hand, promotion:i, holiday_flag:i"
PANEL_COLS = "product_name, category, week_start, sales_qty, price, stock_on_hand, promotion, holiday_flag"

# panel with holes: the nulls, infinities and empty column the cleaning operators must handle
CTES["holey"] = """
SELECT product_name, category, week_start,
       CASE WHEN DAY(week_start) % 7 = 0 THEN NULL ELSE sales_qty END AS sales_qty,
       CASE WHEN DAY(week_start) % 5 = 0 THEN NULL ELSE price END AS price,
       CASE WHEN DAY(week_start) % 11 = 0 THEN NULL ELSE stock_on_hand END AS stock_on_hand,
       CASE WHEN DAY(week_start) % 3 = 0 THEN NULL ELSE promotion END AS promotion,
       CASE WHEN DAY(week_start) % 13 = 0 THEN NULL ELSE holiday_flag END AS holiday_flag,
       CASE WHEN DAY(week_start) % 6 = 0 THEN NULL ELSE weather END AS weather,
       availability
FROM panel
"""


def holey(t):
    day = F.day(TIME)

    def hole(c, k):
        return F.when(day % k != 0, F.col(c)).alias(c)

    return t.panel.select(
        KEY, "category", TIME, hole("sales_qty", 7), hole("price", 5), hole("stock_on_hand", 11),
        hole("promotion", 3), hole("holiday_flag", 13), hole("weather", 6), "availability",
    )


def product_key(t):
    """The raw product table with the id columns a sales upload may carry."""
    return t.part.select(
        F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("sku"), "p_size", "p_retailprice",
    )


PRODUCT_KEY = """SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name, p_brand AS sku,
                 p_size, p_retailprice FROM part"""

SEASON_SQL = """CASE WHEN MONTH(week_start) IN (12, 1, 2) THEN 'Winter' WHEN MONTH(week_start) <= 5 THEN 'Spring'
                     WHEN MONTH(week_start) <= 8 THEN 'Summer' ELSE 'Fall' END"""

# ---- filters and projections

query("filter_product", PANEL, lambda t: P.filter_product(t.panel, "Brand#11"),
      f"SELECT {PANEL_COLS} FROM panel WHERE product_name = 'Brand#11'")

query("filter_any_id", "product_id, product_name, sku, p_size:i",
      lambda t: P.filter_any_id(product_key(t), "Brand#11"),
      f"SELECT * FROM ({PRODUCT_KEY}) WHERE product_id = 'Brand#11' OR product_name = 'Brand#11' OR sku = 'Brand#11'")

query("filter_contains_ci", "p_partkey:i, p_name", lambda t: P.filter_contains_ci(t.part, "p_name", "BLUE"),
      "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%blue%'")

# weeks on promotion carry a code-like product label
query("filter_code_regex", "label, week_start:d, sales_qty",
      lambda t: P.filter_code_regex(
          t.panel.withColumn("label", F.when(F.col("promotion") == 1, F.replace(KEY, F.lit("Brand#"), F.lit("P")))
                             .otherwise(F.col(KEY))), "label"),
      """WITH labelled AS (SELECT *, CASE WHEN promotion = 1 THEN REPLACE(product_name, 'Brand#', 'P')
                                     ELSE product_name END AS label FROM panel),
              marked AS (SELECT *, regexp_matches(UPPER(label), '^(P\\d+|PROD\\d+|[A-Z]{1,3}\\d+)$') AS code FROM labelled)
         SELECT label, week_start, sales_qty FROM marked
         WHERE NOT code OR NOT EXISTS (SELECT 1 FROM marked WHERE NOT code)""")

query("filter_valid_prices", PANEL, lambda t: P.filter_valid_prices(holey(t)),
      f"""SELECT {PANEL_COLS} FROM holey WHERE sales_qty IS NOT NULL AND price IS NOT NULL AND product_name IS NOT NULL
          AND sales_qty > 0 AND price > 0""")

query("filter_isin", PANEL, lambda t: P.filter_isin(t.panel, "category", ["CAT1", "CAT3"]),
      f"SELECT {PANEL_COLS} FROM panel WHERE category IN ('CAT1', 'CAT3')")

query("project_numeric", "sales_qty, ratio, stock_on_hand, promotion:i",
      lambda t: P.project_numeric(
          holey(t).select("category", "sales_qty", "stock_on_hand", "promotion",
                          F.when(F.col("availability") == 0, F.lit(float("inf"))).otherwise(F.col("price")).alias("ratio"),
                          F.lit(None).cast("double").alias("empty"))),
      """SELECT sales_qty, stock_on_hand, promotion, CASE WHEN availability = 0 THEN NULL ELSE price END AS ratio FROM holey""")

query("revenue", "product_name, week_start:d, revenue:2", lambda t: P.revenue(t.panel),
      "SELECT product_name, week_start, price * sales_qty AS revenue FROM panel")

query("safe_divide", "product_name, week_start:d, x:6",
      lambda t: P.ratio(holey(t).withColumn("b", F.when(F.col("promotion") == 1, F.col("stock_on_hand")).otherwise(0)),
                        "sales_qty", "b", "x"),
      """SELECT product_name, week_start,
                COALESCE(sales_qty / NULLIF(CASE WHEN promotion = 1 THEN stock_on_hand ELSE 0 END, 0), 0) AS x FROM holey""")

query("stock_ratios", "product_name, week_start:d, stock_sales_ratio:6, sales_stock_ratio:6, days_of_stock:6",
      lambda t: P.stock_ratios(t.panel),
      """SELECT product_name, week_start, stock_on_hand / (sales_qty + 1) AS stock_sales_ratio,
                sales_qty / (stock_on_hand + 1) AS sales_stock_ratio,
                stock_on_hand / (sales_qty + 1) AS days_of_stock FROM panel""")

query("stock_flags", "product_name, week_start:d, low_stock:i, high_stock:i, stock_median:6", lambda t: P.stock_flags(t.panel),
      """SELECT product_name, week_start, m AS stock_median,
                CASE WHEN stock_on_hand < m * 0.5 THEN 1 ELSE 0 END AS low_stock,
                CASE WHEN stock_on_hand > m * 2 THEN 1 ELSE 0 END AS high_stock
         FROM panel, (SELECT MEDIAN(stock_on_hand) AS m FROM panel)""")

query("season_flags", "product_name, date:d, is_year_end:i, is_year_start:i, is_mid_year:i, is_q1:i, is_q2:i, is_q3:i, is_q4:i, is_weekend:i",
      lambda t: P.season_flags(t.daily, "date"),
      """SELECT product_name, date, CAST(MONTH(date) IN (11, 12) AS INT) AS is_year_end,
                CAST(MONTH(date) IN (1, 2) AS INT) AS is_year_start, CAST(MONTH(date) IN (6, 7) AS INT) AS is_mid_year,
                CAST(QUARTER(date) = 1 AS INT) AS is_q1, CAST(QUARTER(date) = 2 AS INT) AS is_q2,
                CAST(QUARTER(date) = 3 AS INT) AS is_q3, CAST(QUARTER(date) = 4 AS INT) AS is_q4,
                CAST(ISODOW(date) >= 6 AS INT) AS is_weekend FROM daily""")

query("season_from_month", "product_name, week_start:d, season", lambda t: P.season_from_month(t.panel),
      f"SELECT product_name, week_start, {SEASON_SQL} AS season FROM panel")

query("binary_flags", "product_name, week_start:d, promotion:i, holiday_flag:i, availability:i", lambda t: P.binary_flags(holey(t)),
      """SELECT product_name, week_start, COALESCE(promotion, 0) AS promotion, COALESCE(holiday_flag, 0) AS holiday_flag,
                COALESCE(availability, 0) AS availability FROM holey""")

query("interactions", "product_name, week_start:d, price_promotion_interaction, holiday_season_interaction:i, stock_availability_interaction:6, price_stock_interaction",
      lambda t: P.interactions(P.label_encode(P.season_from_month(t.panel), ["season"])),
      f"""WITH s AS (SELECT *, {SEASON_SQL} AS season FROM panel)
         SELECT product_name, week_start, price * promotion AS price_promotion_interaction,
                holiday_flag * (DENSE_RANK() OVER (ORDER BY season) - 1) AS holiday_season_interaction,
                stock_on_hand * availability AS stock_availability_interaction,
                price * stock_on_hand AS price_stock_interaction FROM s""")

query("one_hot", "product_name, week_start:d, season_Fall:i, season_Spring:i, season_Summer:i, season_Winter:i",
      lambda t: P.one_hot(P.season_from_month(t.panel), {"season": ["Fall", "Spring", "Summer", "Winter"]}),
      f"""SELECT product_name, week_start, CAST(s = 'Fall' AS INT) AS season_Fall, CAST(s = 'Spring' AS INT) AS season_Spring,
                 CAST(s = 'Summer' AS INT) AS season_Summer, CAST(s = 'Winter' AS INT) AS season_Winter
          FROM (SELECT *, {SEASON_SQL} AS s FROM panel)""")

query("clip", "product_name, week_start:d, sales_qty", lambda t: P.clip(holey(t), "sales_qty", 50.0, 600.0),
      """SELECT product_name, week_start, CASE WHEN sales_qty < 50 THEN 50 WHEN sales_qty > 600 THEN 600
                ELSE sales_qty END AS sales_qty FROM holey""")

query("format_report", "product_name, week_start:d, price_text, change_text, share_text, message",
      lambda t: P.format_report(
          t.panel.withColumns({
              "new_price": F.col("price") * F.when(F.col("promotion") == 1, 0.9).otherwise(1.05),
              "share": F.col("promotion") * 0.25, "urgency": F.lit("WARNING"),
              "weeks": F.floor(F.col("stock_on_hand")) / 4})),
      """SELECT product_name, week_start, '$' || format('{:,.2f}', price) AS price_text,
                CASE WHEN promotion = 1 THEN '-10.0%' ELSE '+5.0%' END AS change_text,
                CASE WHEN promotion = 1 THEN '25%' ELSE '0%' END AS share_text,
                'WARNING - ' || product_name || ' has ' || printf('%.1f', FLOOR(stock_on_hand) / 4 + 1e-9) || ' weeks of stock left' AS message
         FROM panel""")

# ---- joins

query("join_product_summary", "product_name, week_start:d, avg_price:6, avg_sales:6, price_variability:6",
      lambda t: A.join_product_summary(t.panel, A.product_summary(t.panel)),
      """SELECT product_name, week_start, AVG(price) OVER p AS avg_price, AVG(sales_qty) OVER p AS avg_sales,
                STDDEV_SAMP(price) OVER p / AVG(price) OVER p AS price_variability
         FROM panel WINDOW p AS (PARTITION BY product_name)""")


def week_spine(t):
    span = t.panel.groupBy(KEY).agg(F.min(TIME).alias("a"), F.max(TIME).alias("b"))
    return span.select(KEY, F.explode(F.expr("sequence(a, b, interval 7 days)")).alias(TIME))


CTES["spine"] = """SELECT product_name, CAST(UNNEST(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS week_start
FROM (SELECT product_name, MIN(week_start) AS a, MAX(week_start) AS b FROM panel GROUP BY 1)"""

query("join_spine", "product_name, week_start:d, sales_qty", lambda t: A.join_spine(t.panel, week_spine(t), [KEY, TIME]),
      "SELECT s.product_name, s.week_start, p.sales_qty FROM spine s LEFT JOIN panel p USING (product_name, week_start)")

query("join_actual_fitted", "product_name, week_start:d, sales_qty, fitted:6",
      lambda t: A.join_actual_fitted(t.panel, t.panel.filter("availability = 1").select(KEY, TIME, (F.col("sales_qty") * 0.5 + 1).alias("fitted"))),
      """SELECT p.product_name, p.week_start, p.sales_qty, f.fitted FROM panel p
         LEFT JOIN (SELECT product_name, week_start, sales_qty * 0.5 + 1 AS fitted FROM panel WHERE availability = 1) f
         USING (product_name, week_start)""")

query("join_reindex", "product_name, week_start:d, sales_qty",
      lambda t: A.join_reindex(week_spine(t), t.panel.filter("holiday_flag = 0"), [KEY, TIME]),
      """SELECT s.product_name, s.week_start, p.sales_qty FROM spine s
         LEFT JOIN (SELECT * FROM panel WHERE holiday_flag = 0) p USING (product_name, week_start)""")

query("semi_top_products", PANEL, lambda t: A.semi_top_products(t.panel, 20),
      f"""SELECT {PANEL_COLS} FROM panel WHERE product_name IN (SELECT product_name FROM panel GROUP BY 1
          ORDER BY SUM(price * sales_qty) DESC, 1 LIMIT 20)""")

query("cross_scalar", "product_name, week_start:d, last_week:d, mean_qty:6",
      lambda t: A.cross_scalar(t.panel, t.panel.agg(F.max(TIME).alias("last_week"), F.avg("sales_qty").alias("mean_qty"))),
      """SELECT product_name, week_start, (SELECT MAX(week_start) FROM panel) AS last_week,
                (SELECT AVG(sales_qty) FROM panel) AS mean_qty FROM panel""")

query("distinct_name_map", "p_partkey:i, p_name", lambda t: A.distinct_name_map(
          t.lineitem.select("l_partkey").distinct().join(t.part, F.col("l_partkey") == F.col("p_partkey")), "p_partkey", "p_name"),
      "SELECT DISTINCT p_partkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")

# ---- aggregates

query("product_summary", """product_name, avg_price:6, price_std:6, min_price, max_price, avg_sales:6, total_sales:2, sales_std:6,
      avg_revenue:3, total_revenue:2, promotion_freq:6, avg_stock:6, category, price_variability:6""",
      lambda t: A.product_summary(P.filter_valid_prices(t.panel)),
      """SELECT product_name, AVG(price) AS avg_price, STDDEV_SAMP(price) AS price_std, MIN(price) AS min_price,
                MAX(price) AS max_price, AVG(sales_qty) AS avg_sales, SUM(sales_qty) AS total_sales,
                STDDEV_SAMP(sales_qty) AS sales_std, AVG(price * sales_qty) AS avg_revenue,
                SUM(price * sales_qty) AS total_revenue, AVG(promotion) AS promotion_freq, AVG(stock_on_hand) AS avg_stock,
                ARG_MIN(category, week_start) AS category, STDDEV_SAMP(price) / AVG(price) AS price_variability
         FROM panel WHERE price > 0 AND sales_qty > 0 GROUP BY 1""")

query("product_series", "date:d, sales_qty, stock_on_hand, price:6, promotion_flag:i, holiday_flag:i",
      lambda t: A.product_series(t.panel.withColumn(KEY, F.col("category")), "CAT1"),
      """SELECT week_start AS date, SUM(sales_qty) AS sales_qty, SUM(stock_on_hand) AS stock_on_hand, AVG(price) AS price,
                MAX(promotion) AS promotion_flag, MAX(holiday_flag) AS holiday_flag
         FROM panel WHERE category = 'CAT1' GROUP BY 1""")

query("category_perf", "category, total_qty:2, mean_qty:6", lambda t: A.category_perf(t.panel),
      """SELECT category, SUM(sales_qty) AS total_qty, AVG(sales_qty) AS mean_qty FROM panel GROUP BY 1
         ORDER BY 2 DESC, 1 LIMIT 10""")

for key, flag, op in (("promo_uplift", "promotion", A.promo_uplift), ("holiday_uplift", "holiday_flag", A.holiday_uplift)):
    query(key, "mean_on:6, mean_off:6, uplift_pct:6", lambda t, op=op: op(t.panel),
          f"""SELECT a AS mean_on, b AS mean_off, COALESCE((a - b) / NULLIF(b, 0) * 100, 0) AS uplift_pct
              FROM (SELECT AVG(sales_qty) FILTER ({flag} = 1) AS a, AVG(sales_qty) FILTER ({flag} = 0) AS b FROM panel)""")

query("season_perf", "season, mean_qty:6", lambda t: A.season_perf(t.panel),
      f"SELECT {SEASON_SQL} AS season, AVG(sales_qty) AS mean_qty FROM panel GROUP BY 1")

query("stock_overview", "avg_stock:6, low_threshold:6, corr_stock_sales:6, low_stock_rows:i", lambda t: A.stock_overview(t.panel),
      """WITH q AS (SELECT QUANTILE_CONT(stock_on_hand, 0.1) AS x FROM panel)
         SELECT AVG(stock_on_hand) AS avg_stock, MAX(x) AS low_threshold, CORR(stock_on_hand, sales_qty) AS corr_stock_sales,
                COUNT(*) FILTER (stock_on_hand <= x) AS low_stock_rows FROM panel, q""")

query("monthly_stock_trend", "year:i, month:i, mean_stock:6, smoothed:6", lambda t: A.monthly_stock_trend(t.panel),
      """WITH m AS (SELECT YEAR(week_start) AS year, MONTH(week_start) AS month, AVG(stock_on_hand) AS mean_stock
                    FROM panel GROUP BY 1, 2)
         SELECT *, (mean_stock + LAG(mean_stock) OVER (PARTITION BY year ORDER BY month)) / 2 AS smoothed FROM m""")

query("price_sales_corr", "corr:6, relation", lambda t: A.price_sales_corr(t.panel),
      """SELECT c AS corr, CASE WHEN c < -0.2 THEN 'negative' WHEN c > 0.2 THEN 'positive' ELSE 'weak' END AS relation
         FROM (SELECT CORR(price, sales_qty) AS c FROM panel)""")

NUM = ["sales_qty", "price", "stock_on_hand", "promotion", "holiday_flag", "availability"]
CTES["corr_long"] = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, " + ("1.0 AS corr" if a == b else f"CASE WHEN isfinite(CORR({a}, {b})) THEN CORR({a}, {b}) END AS corr FROM panel") for a in NUM for b in NUM
)
query("corr_matrix", "a, b, corr:6", lambda t: A.corr_matrix(t.panel), "SELECT * FROM corr_long")
query("corr_strong_pairs", "a, b, corr:6, abs_corr:6", lambda t: A.corr_strong_pairs(A.corr_matrix(t.panel)),
      "SELECT a, b, corr, ABS(corr) AS abs_corr FROM corr_long WHERE a < b AND ABS(corr) > 0.5")

HN = ["sales_qty", "price", "stock_on_hand", "promotion", "holiday_flag", "availability"]
HT = ["product_name", "category", "weather"]
_num_desc = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, COUNT({c}) AS count, AVG({c}) AS mean, STDDEV_SAMP({c}) AS std, CAST(MIN({c}) AS DOUBLE) AS min,
        QUANTILE_CONT({c}, 0.25) AS q1, QUANTILE_CONT({c}, 0.5) AS median, QUANTILE_CONT({c}, 0.75) AS q3,
        CAST(MAX({c}) AS DOUBLE) AS max, NULL AS "unique", NULL AS top, NULL AS freq FROM holey""" for c in HN)
_text_desc = " UNION ALL ".join(
    f"""SELECT '{c}', COUNT({c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, COUNT(DISTINCT {c}),
        (SELECT {c} FROM holey WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1),
        (SELECT COUNT(*) FROM holey WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1) FROM holey""" for c in HT)
query("describe_table", "name, count:i, mean:6, std:6, min:6, q1:6, median:6, q3:6, max:6, unique:i, top, freq:i",
      lambda t: A.describe_table(holey(t)), f"{_num_desc} UNION ALL {_text_desc}")

HCOLS = ["product_name", "category", "week_start", *HN, "weather"]
query("missing_report", "column, missing:i, missing_pct:2", lambda t: A.missing_report(holey(t)),
      " UNION ALL ".join(f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing,
                             ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS missing_pct FROM holey""" for c in HCOLS))

_prof = []
for c in HCOLS:
    num = c in HN
    kind = "numeric" if num else "datetime" if c == "week_start" else "object"
    stat = f"CAST(MIN({c}) AS DOUBLE), CAST(MAX({c}) AS DOUBLE), AVG({c}), STDDEV_SAMP({c})" if num else "NULL, NULL, NULL, NULL"
    top = (f"(SELECT {c} FROM holey WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1), "
           f"(SELECT COUNT(*) FROM holey WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 1 DESC LIMIT 1)") if kind == "object" else "NULL, NULL"
    _prof.append(f"SELECT '{c}', '{kind}', COUNT({c}), COUNT(*) - COUNT({c}), ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2), "
                 f"COUNT(DISTINCT {c}), {stat}, {top} FROM holey")
query("column_profile", "column, kind, non_null:i, missing:i, missing_pct:2, unique:i, min:6, max:6, mean:6, std:6, top, freq:i",
      lambda t: A.column_profile(holey(t)),
      f"""WITH prof("column", kind, non_null, missing, missing_pct, "unique", min, max, mean, std, top, freq)
          AS ({' UNION ALL '.join(_prof)}) SELECT * FROM prof""")

_cells = " + ".join(f"COUNT(*) - COUNT({c})" for c in HCOLS)
query("table_health", "rows:i, columns:i, missing_cells:i, missing_pct:2, completeness_pct:2, duplicate_rows:i, latest:d, status",
      lambda t: A.table_health(holey(t)),
      f"""WITH h AS (SELECT COUNT(*) AS n, {_cells} AS m, MAX(week_start) AS latest FROM holey),
              p AS (SELECT *, ROUND(m * 100.0 / (n * {len(HCOLS)}), 2) AS pc FROM h)
         SELECT n AS rows, {len(HCOLS)} AS columns, m AS missing_cells, pc AS missing_pct, 100 - pc AS completeness_pct,
                n - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM holey)) AS duplicate_rows, latest,
                CASE WHEN pc < 5 THEN 'Excellent' WHEN pc < 15 THEN 'Good' ELSE 'Needs Attention' END AS status FROM p""")

query("duplicate_rows", "duplicate_rows:i",
      lambda t: A.duplicate_rows(t.lineitem),
      "SELECT COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_rows FROM lineitem")

query("quick_summary", "rows:i, columns:i, first_date:d, last_date:d, products:i, top_categories", lambda t: A.quick_summary(t.panel),
      """SELECT COUNT(*) AS rows, 10 AS columns, MIN(week_start) AS first_date, MAX(week_start) AS last_date,
                COUNT(DISTINCT product_name) AS products,
                (SELECT STRING_AGG(category, ', ' ORDER BY n DESC, category) FROM (SELECT category, COUNT(*) AS n FROM panel
                 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS top_categories FROM panel""")

query("distinct_counts", "n_l_suppkey:i, n_l_partkey:i, n_l_returnflag:i",
      lambda t: A.distinct_counts(t.lineitem, ["l_suppkey", "l_partkey", "l_returnflag"]),
      """SELECT COUNT(DISTINCT l_suppkey) AS n_l_suppkey, COUNT(DISTINCT l_partkey) AS n_l_partkey,
                COUNT(DISTINCT l_returnflag) AS n_l_returnflag FROM lineitem""")

query("top_values", "p_type, n:i", lambda t: A.top_values(t.part, "p_type", 10),
      "SELECT p_type, COUNT(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")

query("weekly_totals", "week_start:d, total_qty:2", lambda t: A.weekly_totals(t.panel),
      "SELECT week_start, SUM(sales_qty) AS total_qty FROM panel GROUP BY 1")

query("monthly_counts", "month, n:i", lambda t: A.monthly_counts(t.panel),
      "SELECT strftime(week_start, '%Y-%m') AS month, COUNT(*) AS n FROM panel GROUP BY 1")

query("category_totals", "category, total_qty:2", lambda t: A.category_totals(t.panel),
      "SELECT category, SUM(sales_qty) AS total_qty FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")

query("product_price_volume", "product_name, mean_price:6, total_qty:2", lambda t: A.product_price_volume(t.panel),
      "SELECT product_name, AVG(price) AS mean_price, SUM(sales_qty) AS total_qty FROM panel GROUP BY 1")


def _long_months(t):
    wide = A.pivot_revenue(t.panel, 20)
    return stacked(wide, "month", "revenue", [(c, F.col(c)) for c in wide.columns if c != KEY], keep=[KEY])


CTES["top20"] = "SELECT product_name FROM panel GROUP BY 1 ORDER BY SUM(price * sales_qty) DESC, 1 LIMIT 20"
query("pivot_revenue", "product_name, month, revenue:2", _long_months,
      """WITH months AS (SELECT strftime(UNNEST(generate_series(date_trunc('month', MIN(week_start)), MAX(week_start), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM panel)
         SELECT t.product_name, m.month, COALESCE(SUM(p.price * p.sales_qty), 0) AS revenue
         FROM top20 t CROSS JOIN months m LEFT JOIN panel p ON p.product_name = t.product_name AND strftime(p.week_start, '%Y-%m') = m.month
         GROUP BY 1, 2""")

_WK = ", ".join(f"w{w}:6" for w in range(1, 54))
query("pivot_month_week", f"product_name, month:i, {_WK}", lambda t: A.pivot_month_week(t.panel, 52),
      """WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY week_start DESC) AS rn FROM panel)
         SELECT product_name, MONTH(week_start) AS month, """
      + ", ".join(f"COALESCE(AVG(sales_qty) FILTER (WEEKOFYEAR(week_start) = {w}), 0) AS w{w}" for w in range(1, 54))
      + " FROM r WHERE rn <= 52 GROUP BY 1, 2")

CTES["month_means"] = "SELECT product_name, MONTH(week_start) AS month, AVG(sales_qty) AS mean_qty FROM panel GROUP BY 1, 2"
CTES["month_prof"] = """
SELECT product_name, p AS peak_month, l AS low_month, hi AS peak_qty, lo AS low_qty, m AS mean_of_means,
       (hi - m) / m * 100 AS peak_pct, (m - lo) / m * 100 AS low_pct
FROM (SELECT product_name, ARG_MIN(month, r1) AS p, ARG_MIN(month, r2) AS l, MAX(mean_qty) AS hi, MIN(mean_qty) AS lo, AVG(mean_qty) AS m
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY mean_qty DESC, month) AS r1,
                   ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY mean_qty, month) AS r2 FROM month_means) GROUP BY 1)
"""
query("month_profile", "product_name, peak_month:i, low_month:i, peak_qty:6, low_qty:6, mean_of_means:6, peak_pct:6, low_pct:6, variation:6, strength",
      lambda t: A.month_profile(t.panel),
      """SELECT *, ABS(peak_pct - low_pct) AS variation,
                CASE WHEN ABS(peak_pct - low_pct) > 30 THEN 'strong' ELSE 'moderate' END AS strength FROM month_prof""")

query("year_week_compare", "year:i, week:i, mean_qty:6", lambda t: A.year_week_compare(t.panel),
      """SELECT YEAR(week_start) AS year, WEEKOFYEAR(week_start) AS week, AVG(sales_qty) AS mean_qty FROM panel
         WHERE YEAR(week_start) IN (SELECT DISTINCT YEAR(week_start) AS y FROM panel ORDER BY y DESC LIMIT 2) GROUP BY 1, 2""")

CTES["cat_season"] = f"""
WITH s AS (SELECT category, {SEASON_SQL} AS season, AVG(sales_qty) AS m FROM panel GROUP BY 1, 2),
     r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY category ORDER BY m DESC, season) AS hi,
                  ROW_NUMBER() OVER (PARTITION BY category ORDER BY m, season) AS lo, COUNT(*) OVER (PARTITION BY category) AS n FROM s)
SELECT category, MAX(season) FILTER (hi = 1) AS peak_season, MAX(m) AS peak_qty, MAX(season) FILTER (lo = 1) AS low_season,
       MIN(m) AS low_qty, (MAX(m) - MIN(m)) / MIN(m) * 100 AS variation_pct
FROM r GROUP BY 1 HAVING MAX(n) > 1 AND MIN(m) > 0
"""
query("category_seasonality", "category, peak_season, peak_qty:6, low_season, low_qty:6, variation_pct:6, level, recommendation",
      lambda t: A.category_seasonality(t.panel),
      """SELECT *, CASE WHEN variation_pct > 50 THEN 'HIGH' WHEN variation_pct > 25 THEN 'MODERATE' ELSE 'LOW' END AS level,
                CASE WHEN variation_pct > 50 THEN 'Raise stock by 40-60% before ' || peak_season
                     WHEN variation_pct > 25 THEN 'Plan a 25-40% stock boost for ' || peak_season
                     ELSE 'Keep stock steady' END AS recommendation FROM cat_season""")

query("flag_correlations", "product_name, promotion_corr:6, holiday_corr:6", lambda t: A.flag_correlations(t.panel),
      """SELECT product_name, CORR(sales_qty, promotion) AS promotion_corr, CORR(sales_qty, holiday_flag) AS holiday_corr
         FROM panel GROUP BY 1""")


def _importances(t):
    """|correlation| of each driver with quantity per category, as a long importance table."""
    found = t.panel.groupBy(F.col("category").alias("model")).agg(*[F.abs(corr("sales_qty", c)).alias(c) for c in NUM[1:5]])
    return stacked(found, "feature", "importance", [(c, F.col(c)) for c in NUM[1:5]], keep=["model"])


CTES["imps"] = " UNION ALL ".join(
    f"SELECT category AS model, '{c}' AS feature, ABS(CORR(sales_qty, {c})) AS importance FROM panel GROUP BY 1" for c in NUM[1:5])
CTES["model_w"] = "SELECT category AS model, SUM(sales_qty) / (SELECT SUM(sales_qty) FROM panel) AS weight FROM panel GROUP BY 1"


def _weights(t):
    total = t.panel.agg(F.sum("sales_qty")).scalar()
    sums = t.panel.groupBy(F.col("category").alias("model")).agg(F.sum("sales_qty").alias("s"))
    return sums.select("model", (F.col("s") / total).alias("weight"))


query("importance_rollup", "feature, importance:6", lambda t: A.importance_rollup(_importances(t), _weights(t)),
      "SELECT feature, SUM(importance * weight) AS importance FROM imps JOIN model_w USING (model) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")

# ---- sorts, top-k, unions

query("topk_months", "product_name, month:i, mean_qty:6, high_rank:i, low_rank:i", lambda t: A.topk_months(t.panel, 3),
      """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY mean_qty DESC, month) AS high_rank,
                ROW_NUMBER() OVER (PARTITION BY product_name ORDER BY mean_qty, month) AS low_rank FROM month_means)
         WHERE high_rank <= 3 OR low_rank <= 3""")

query("topk_products", "product_name, total_revenue:2", lambda t: A.topk_products(t.panel, 20),
      "SELECT product_name, SUM(price * sales_qty) AS total_revenue FROM panel GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")

query("sort_abs", "product_name, week_start:d, dev:6",
      lambda t: A.sort_abs(t.panel.select(KEY, TIME, (F.col("sales_qty") - 1500).alias("dev")), "dev", 50, KEY, TIME),
      """SELECT product_name, week_start, sales_qty - 1500 AS dev FROM panel
         ORDER BY ABS(sales_qty - 1500) DESC, product_name, week_start LIMIT 50""")

query("sample_rows", "product_name, week_start:d, sales_qty", lambda t: A.sample_rows(t.panel, 2000, [KEY, TIME]))


def _two_models(t):
    a = t.panel.select(KEY, TIME, F.avg("sales_qty").over(ordered().rowsBetween(-3, 0)).alias("yhat"))
    b = t.panel.select(KEY, TIME, F.lag("sales_qty").over(ordered()).alias("yhat"))
    return A.union_models(a, b, ("mean4", "naive"))


query("union_models", "product_name, week_start:d, yhat:6, model", _two_models,
      """SELECT product_name, week_start, AVG(sales_qty) OVER (PARTITION BY product_name ORDER BY week_start ROWS 3 PRECEDING) AS yhat, 'mean4' AS model FROM panel
         UNION ALL SELECT product_name, week_start, LAG(sales_qty) OVER (PARTITION BY product_name ORDER BY week_start), 'naive' FROM panel""")

query("union_products", "product_name, week_start:d, sales_qty, price, stock_on_hand",
      lambda t: A.union_products([t.panel.filter("promotion = 1").select(KEY, TIME, "sales_qty", "price"),
                                  t.panel.filter("promotion = 0").select(KEY, TIME, "sales_qty", "stock_on_hand")]),
      """SELECT product_name, week_start, sales_qty, price, NULL AS stock_on_hand FROM panel WHERE promotion = 1
         UNION ALL SELECT product_name, week_start, sales_qty, NULL, stock_on_hand FROM panel WHERE promotion = 0""")

query("union_placeholder", "category, peak_season, variation_pct:6",
      lambda t: A.union_placeholder(
          A.category_seasonality(t.panel).filter("variation_pct > 500").select("category", "peak_season", "variation_pct"),
          {"category": "NONE", "peak_season": "N/A", "variation_pct": 0.0}),
      """WITH hot AS (SELECT category, peak_season, variation_pct FROM cat_season WHERE variation_pct > 500)
         SELECT * FROM hot UNION ALL SELECT 'NONE', 'N/A', 0.0 WHERE NOT EXISTS (SELECT 1 FROM hot)""")

query("distinct_values", "product_name", lambda t: A.distinct_values(t.panel), "SELECT DISTINCT product_name FROM panel")

# ---- scalar function groups

query("scalar_string", "product_name, week_start:d, low, trimmed, replaced, has:b, code:b, upp, titled, joined, formatted",
      lambda t: t.panel.select(
          KEY, TIME, F.lower(KEY).alias("low"), F.trim(F.concat(F.lit("  "), KEY, F.lit(" "))).alias("trimmed"),
          F.replace(KEY, F.lit("#"), F.lit("_")).alias("replaced"), F.col(KEY).contains("1").alias("has"),
          F.col("category").rlike(r"^[A-Z]{1,3}\d+$").alias("code"), F.upper(KEY).alias("upp"),
          F.initcap(F.lit("sales drop")).alias("titled"),
          F.array_join(F.array("category", "weather"), " and ").alias("joined"),
          F.format_string("%s: %d units", F.col(KEY), F.col("sales_qty").cast("bigint")).alias("formatted")),
      """SELECT product_name, week_start, LOWER(product_name) AS low, TRIM('  ' || product_name || ' ') AS trimmed,
                REPLACE(product_name, '#', '_') AS replaced, CONTAINS(product_name, '1') AS has,
                regexp_matches(category, '^[A-Z]{1,3}\\d+$') AS code, UPPER(product_name) AS upp, 'Sales Drop' AS titled,
                category || ' and ' || weather AS joined,
                printf('%s: %d units', product_name, CAST(sales_qty AS BIGINT)) AS formatted FROM panel""")

query("scalar_date", "product_name, date:d, parsed:d, bad:d, y:i, m:i, q:i, wk:i, doy:i, dom:i, dow:i, period, text, plus:d, days:i",
      lambda t: t.daily.select(
          KEY, "date", F.try_to_date(F.date_format("date", "MM/dd/yyyy"), "MM/dd/yyyy").alias("parsed"),
          F.try_to_date(F.concat(F.lit("x"), F.col("date").cast("string")), "yyyy-MM-dd").alias("bad"),
          F.year("date").alias("y"), F.month("date").alias("m"), F.quarter("date").alias("q"),
          F.weekofyear("date").alias("wk"), F.dayofyear("date").alias("doy"), F.day("date").alias("dom"),
          F.weekday("date").alias("dow"), F.date_format("date", "yyyy-MM").alias("period"),
          F.date_format("date", "yyyy-MM-dd").alias("text"), F.date_add("date", 28).alias("plus"),
          F.datediff("date", F.lit("1995-01-01").cast("date")).alias("days")),
      """SELECT product_name, date, CAST(strptime(strftime(date, '%m/%d/%Y'), '%m/%d/%Y') AS DATE) AS parsed, NULL AS bad,
                YEAR(date) AS y, MONTH(date) AS m, QUARTER(date) AS q, WEEKOFYEAR(date) AS wk, DAYOFYEAR(date) AS doy,
                DAY(date) AS dom, ISODOW(date) - 1 AS dow, strftime(date, '%Y-%m') AS period, strftime(date, '%Y-%m-%d') AS text,
                date + 28 AS plus, date - DATE '1995-01-01' AS days FROM daily""")

query("scalar_math", "product_name, week_start:d, s:6, c:6, l:6, l1:6, e1:4, ex:6, sq:6, pw:6, ab:9, rd:2, ce:i, fl:i, cl:6",
      lambda t: t.panel.select(
          KEY, TIME, F.sin("sales_qty").alias("s"), F.cos("sales_qty").alias("c"), F.log(F.col("price") + 1e-6).alias("l"),
          F.log1p("sales_qty").alias("l1"), F.expm1(F.log1p("sales_qty")).alias("e1"),
          F.exp(-F.col("price") / 1000).alias("ex"), F.sqrt("sales_qty").alias("sq"), F.pow(F.col("price") / 1000, -1.2).alias("pw"),
          F.abs(F.col("price") - 1500).alias("ab"), F.round("sales_qty", 2).alias("rd"), F.ceil(F.col("sales_qty") / 7).alias("ce"),
          F.floor(F.col("sales_qty") / 7).alias("fl"), F.greatest(F.least("sales_qty", F.lit(400.0)), F.lit(10.0)).alias("cl")),
      """SELECT product_name, week_start, SIN(sales_qty) AS s, COS(sales_qty) AS c, LN(price + 1e-6) AS l, LN(1 + sales_qty) AS l1,
                sales_qty AS e1, EXP(-price / 1000) AS ex, SQRT(sales_qty) AS sq, POW(price / 1000, -1.2) AS pw, ABS(price - 1500) AS ab,
                ROUND(sales_qty, 2) AS rd, CEIL(sales_qty / 7) AS ce, FLOOR(sales_qty / 7) AS fl,
                GREATEST(LEAST(sales_qty, 400.0), 10.0) AS cl FROM panel""")

query("scalar_statistics", "product_name, mean:6, sd:6, sdp:6, q1:6, med:6, mode, corr:6, slope:6",
      lambda t: t.panel.groupBy(KEY).agg(
          F.avg("price").alias("mean"), F.stddev_samp("sales_qty").alias("sd"), F.stddev_pop("sales_qty").alias("sdp"),
          F.percentile("sales_qty", F.lit(0.25)).alias("q1"), F.median("sales_qty").alias("med"), F.mode("weather", True).alias("mode"),
          corr("price", "sales_qty").alias("corr"), F.regr_slope("sales_qty", "price").alias("slope")),
      """SELECT product_name, AVG(price) AS mean, STDDEV_SAMP(sales_qty) AS sd, STDDEV_POP(sales_qty) AS sdp,
                QUANTILE_CONT(sales_qty, 0.25) AS q1, MEDIAN(sales_qty) AS med,
                (SELECT weather FROM panel i WHERE i.product_name = panel.product_name GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS mode,
                CORR(price, sales_qty) AS corr, REGR_SLOPE(sales_qty, price) AS slope FROM panel GROUP BY 1""")

query("scalar_null", "product_name, week_start:d, filled, missing:b, finite:b, cleaned",
      lambda t: holey(t).dropna(subset=["stock_on_hand"]).withColumn(
          "x", F.when(F.col("availability") == 0, F.lit(float("inf"))).otherwise(F.col("sales_qty"))).select(
          KEY, TIME, F.coalesce("price", F.lit(0.0)).alias("filled"), F.isnull("price").alias("missing"),
          F.coalesce(~F.isnan("x") & (F.abs("x") != float("inf")), F.lit(False)).alias("finite"),
          F.when(F.abs("x") != float("inf"), F.col("x")).alias("cleaned")),
      """WITH x AS (SELECT *, CASE WHEN availability = 0 THEN CAST('Infinity' AS DOUBLE) ELSE sales_qty END AS x
                    FROM holey WHERE stock_on_hand IS NOT NULL)
         SELECT product_name, week_start, COALESCE(price, 0) AS filled, price IS NULL AS missing,
                COALESCE(isfinite(x), FALSE) AS finite, CASE WHEN isfinite(x) THEN x END AS cleaned FROM x""")

query("scalar_array_map", "product_name, week_start:d, left_after:6, first_empty:i, seg_mean:9, top_keys",
      lambda t: t.panel.select(
          KEY, TIME,
          F.aggregate(F.sequence(F.lit(1), F.lit(30)), F.col("stock_on_hand"),
                      lambda a, _: F.greatest(F.lit(0.0), a - F.col("sales_qty") / 7)).alias("left_after"),
          F.coalesce(F.nullif(F.array_position(F.transform(F.sequence(F.lit(1), F.lit(30)),
                     lambda d: F.col("stock_on_hand") - d * F.floor("sales_qty") <= 0), True), F.lit(0)) - 1, F.lit(30)).alias("first_empty"),
          (F.aggregate(F.map_values(F.create_map(F.lit("premium"), F.col("price") * 1.2, F.lit("standard"), F.col("price"),
                                                 F.lit("price_sensitive"), F.col("price") * 0.8)),
                       F.lit(0.0), lambda a, x: a + x) / 3).alias("seg_mean"),
          F.array_join(F.transform(F.slice(F.array_sort(F.transform(
              F.map_entries(F.create_map(F.lit("qty"), F.col("sales_qty"), F.lit("stock"), F.col("stock_on_hand"),
                                         F.lit("price"), -F.col("price"), F.lit("promo"), F.col("promotion").cast("double"))),
              lambda e: F.struct((-F.abs(e["value"])).alias("k"), e["key"].alias("n")))), 1, 3), lambda e: e["n"]), ", ").alias("top_keys")),
      """SELECT product_name, week_start,
                list_reduce(list_prepend(stock_on_hand, list_transform(range(1, 31), lambda d: sales_qty / 7)),
                            lambda a, x: GREATEST(0.0, a - x)) AS left_after,
                LEAST(30, GREATEST(0, CEIL(stock_on_hand / FLOOR(sales_qty)) - 1)) AS first_empty,
                (price * 1.2 + price + price * 0.8) / 3 AS seg_mean,
                array_to_string(list_transform(list_slice(list_sort([{'k': -ABS(sales_qty), 'n': 'qty'}, {'k': -ABS(stock_on_hand), 'n': 'stock'},
                  {'k': -ABS(price), 'n': 'price'}, {'k': -ABS(CAST(promotion AS DOUBLE)), 'n': 'promo'}]), 1, 3), lambda e: e.n), ', ') AS top_keys
         FROM panel""")

query("scalar_json", "product_name, week_start:d, js",
      lambda t: t.panel.select(KEY, TIME, F.to_json(F.struct(KEY, "category", "promotion")).alias("js")),
      """SELECT product_name, week_start, '{"product_name":"' || product_name || '","category":"' || category || '","promotion":' || promotion || '}' AS js
         FROM panel""")
