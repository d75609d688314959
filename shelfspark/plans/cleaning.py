"""Coercion, imputation, resampling and smoothing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY, TIME
from shelfspark.operators import cleaning as C
from shelfspark.plans.registry import CTES, query
from shelfspark.plans.relational import HN, HT, holey, week_spine

# a text upload: day-first dates, quantities with some text in them
MESSY_QTY = "CASE WHEN holiday_flag = 1 AND promotion = 1 THEN 'n/a' WHEN promotion = 1 THEN CAST(CAST(sales_qty AS BIGINT) AS VARCHAR) || '.50' ELSE CAST(CAST(sales_qty AS BIGINT) AS VARCHAR) END"
CTES["upload"] = f"""
SELECT product_name, CASE WHEN weather = 'R' AND holiday_flag = 1 THEN 'unknown' ELSE strftime(date, '%d/%m/%Y') END AS date_text,
       {MESSY_QTY} AS qty_text, date, weather, holiday_flag, promotion, sales_qty FROM daily
"""


def upload(t):
    whole = F.col("sales_qty").cast("bigint").cast("string")
    bad = (F.col("holiday_flag") == 1) & (F.col("promotion") == 1)
    return t.daily.select(
        KEY,
        F.when((F.col("weather") == "R") & (F.col("holiday_flag") == 1), "unknown")
        .otherwise(F.date_format("date", "dd/MM/yyyy")).alias("date_text"),
        F.when(bad, "n/a").when(F.col("promotion") == 1, F.concat(whole, F.lit(".50"))).otherwise(whole).alias("qty_text"),
        "date", "weather", "holiday_flag", "promotion", "sales_qty",
    )


query("coerce_date", "product_name, date:d, date_text:d", lambda t: C.coerce_date(upload(t), "date_text"),
      """WITH m AS (SELECT *, CAST(try_strptime(date_text, '%m/%d/%Y') AS DATE) AS md, CAST(try_strptime(date_text, '%d/%m/%Y') AS DATE) AS dm FROM upload)
         SELECT product_name, date, CASE WHEN (SELECT AVG(CASE WHEN md IS NULL THEN 1.0 ELSE 0.0 END) FROM m) > 0.5 THEN dm ELSE md END AS date_text FROM m""")

query("coerce_numeric", "product_name, date:d, qty_text, bad_qty_text:i",
      lambda t: C.with_scalars(C.coerce_numeric(upload(t), ["qty_text"]), C.coerce_report(upload(t), ["qty_text"])),
      """SELECT product_name, date, COALESCE(TRY_CAST(qty_text AS DOUBLE), 0) AS qty_text,
                (SELECT COUNT(*) FROM upload WHERE TRY_CAST(qty_text AS DOUBLE) IS NULL) AS bad_qty_text FROM upload""")

_mean = ", ".join(f"COALESCE({c}, (SELECT AVG({c}) FROM holey)) AS {c}" for c in HN)
_mode = ", ".join(f"COALESCE({c}, (SELECT {c} FROM holey WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1)) AS {c}" for c in HT)
_n = "sales_qty:6, price:9, stock_on_hand:6, promotion:6, holiday_flag:6, availability:6"
query("impute_mean_mode", f"product_name, category, weather, week_start:d, {_n}", lambda t: C.impute_mean_mode(holey(t)),
      f"SELECT {_mode}, {_mean}, week_start FROM holey")

_med = ", ".join(f"COALESCE({c}, (SELECT MEDIAN({c}) FROM holey)) AS {c}" for c in HN)
query("impute_median", f"product_name, week_start:d, {_n}", lambda t: C.impute_median(holey(t), HN),
      f"SELECT product_name, {_med}, week_start FROM holey")

query("preprocess_dates_median", f"product_name, week_start:d, {_n}",
      lambda t: C.preprocess_dates_median(holey(t).withColumn(
          TIME, F.when(F.col("availability") == 0, "soon").otherwise(F.date_format(TIME, "yyyy-MM-dd")))),
      f"SELECT product_name, {_med}, CASE WHEN availability = 0 THEN NULL ELSE week_start END AS week_start FROM holey")


def _fb(c, order="week_start"):
    w = f"PARTITION BY product_name ORDER BY {order} ROWS BETWEEN"
    return (f"LAST_VALUE({c} IGNORE NULLS) OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW)",
            f"FIRST_VALUE({c} IGNORE NULLS) OVER ({w} CURRENT ROW AND UNBOUNDED FOLLOWING)")


query("ffill_bfill", "product_name, week_start:d, sales_qty, price", lambda t: C.ffill_bfill(holey(t), KEY, ["sales_qty", "price"]),
      "SELECT product_name, week_start, " + ", ".join(f"COALESCE({_fb(c)[0]}, {_fb(c)[1]}, 0) AS {c}" for c in ("sales_qty", "price")) + " FROM holey")

query("fill_context", "product_name, week_start:d, price:9, stock_on_hand, promotion:i, holiday_flag:i", lambda t: C.fill_context(holey(t)),
      f"""SELECT product_name, week_start, COALESCE({_fb('price')[0]}, QUANTILE_CONT(price, 0.5) OVER (PARTITION BY product_name)) AS price,
                 COALESCE({_fb('stock_on_hand')[0]}, 0) AS stock_on_hand, COALESCE(promotion, 0) AS promotion,
                 COALESCE(holiday_flag, 0) AS holiday_flag FROM holey""")

query("dedupe_keep_last", "user_id:i, day:d, event_id:i, event_type, value",
      lambda t: C.dedupe_keep_last(t.events.select("user_id", F.col("ts").cast("date").alias("day"), "ts", "event_id", "event_type", "value"),
                                   ["user_id", "day"], ["ts", "event_id"]),
      """SELECT user_id, day, event_id, event_type, value FROM (SELECT *, CAST(ts AS DATE) AS day,
             ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")

CTES["day_spine"] = """SELECT product_name, CAST(UNNEST(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT product_name, MIN(date) AS a, MAX(date) AS b FROM daily GROUP BY 1)"""
query("spine_daily", "product_name, date:d, sales_qty, price", lambda t: C.spine_daily(t.daily),
      "SELECT s.product_name, s.date, d.sales_qty, d.price FROM day_spine s LEFT JOIN daily d USING (product_name, date)")

query("resample_weekly", "product_name, date:d, sales_qty", lambda t: C.resample_weekly(t.daily),
      """WITH w AS (SELECT product_name, date_trunc('week', date) + INTERVAL 6 DAY AS wk, SUM(sales_qty) AS s FROM daily GROUP BY 1, 2),
              sp AS (SELECT product_name, UNNEST(generate_series(MIN(wk), MAX(wk), INTERVAL 7 DAY)) AS wk FROM w GROUP BY 1)
         SELECT product_name, CAST(wk AS DATE) AS date, COALESCE(s, 0) AS sales_qty FROM sp LEFT JOIN w USING (product_name, wk)""")

# a daily series with zeros and negatives; category CAT2 is mostly zero
CTES["zeroed"] = """SELECT product_name, category, date,
    CASE WHEN category = 'CAT2' AND DAY(date) % 4 <> 0 THEN 0 WHEN DAY(date) % 5 = 0 THEN 0
         WHEN DAY(date) % 9 = 0 THEN -sales_qty ELSE sales_qty END AS sales_qty FROM daily"""


def zeroed(t):
    d = F.day("date")
    q = F.when((F.col("category") == "CAT2") & (d % 4 != 0), 0.0).when(d % 5 == 0, 0.0).when(d % 9 == 0, -F.col("sales_qty")).otherwise(F.col("sales_qty"))
    return t.daily.select(KEY, "category", "date", q.alias("sales_qty"))


_f, _b = _fb("v", "date")
CTES["zero_done"] = f"""
WITH z AS (SELECT product_name, date, GREATEST(sales_qty, 0) AS q FROM zeroed),
     n AS (SELECT product_name, date, NULLIF(q, 0) AS v, AVG(CASE WHEN q = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY product_name) > 0.5 AS sparse FROM z)
SELECT product_name, date, CASE WHEN sparse THEN COALESCE({_f}, {_b}) ELSE v END AS sales_qty FROM n
"""
query("zero_policy", "product_name, date:d, sales_qty", lambda t: C.zero_policy(zeroed(t)), "SELECT * FROM zero_done")

# weekly spine with short and long gaps
CTES["gappy"] = """SELECT s.product_name, s.week_start,
    CASE WHEN DAY(s.week_start) % 7 = 0 OR (p.category = 'CAT1' AND MONTH(s.week_start) BETWEEN 6 AND 8) OR YEAR(s.week_start) = 2001 AND p.category = 'CAT3'
         THEN NULL ELSE p.sales_qty END AS sales_qty FROM spine s LEFT JOIN panel p USING (product_name, week_start)"""


def gappy(t):
    cat, wk = F.col("category"), F.col(TIME)
    gap = (F.day(wk) % 7 == 0) | ((cat == "CAT1") & F.month(wk).between(6, 8)) | ((F.year(wk) == 2001) & (cat == "CAT3"))
    rows = week_spine(t).join(t.panel, [KEY, TIME], "left")
    return rows.select(KEY, TIME, F.when(~F.coalesce(gap, F.lit(False)), F.col("sales_qty")).alias("sales_qty"))


_w = "PARTITION BY product_name ORDER BY week_start"
query("interpolate_linear", "product_name, week_start:d, sales_qty:6", lambda t: C.interpolate_linear(gappy(t)),
      f"""WITH r AS (SELECT *, ROW_NUMBER() OVER ({_w}) AS rn FROM gappy),
              k AS (SELECT *, CASE WHEN sales_qty IS NOT NULL THEN rn END AS kn, CASE WHEN sales_qty IS NOT NULL THEN week_start END AS kt FROM r),
              x AS (SELECT *, LAST_VALUE(sales_qty IGNORE NULLS) OVER p AS pv, LAST_VALUE(kn IGNORE NULLS) OVER p AS pn, LAST_VALUE(kt IGNORE NULLS) OVER p AS pt,
                       FIRST_VALUE(sales_qty IGNORE NULLS) OVER n AS nv, FIRST_VALUE(kt IGNORE NULLS) OVER n AS nt FROM k
                    WINDOW p AS ({_w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS ({_w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
         SELECT product_name, week_start, CASE WHEN sales_qty IS NOT NULL THEN sales_qty WHEN pv IS NULL OR rn - pn > 8 THEN NULL
                WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (week_start - pt) / (nt - pt) END AS sales_qty FROM x""")

CTES["capped"] = """SELECT product_name, date, price, stock_on_hand, promotion, holiday_flag, LEAST(GREATEST(sales_qty, GREATEST(0, q1 - 2 * (q3 - q1))), q3 + 2 * (q3 - q1)) AS sales_qty
FROM daily JOIN (SELECT product_name, QUANTILE_CONT(sales_qty, 0.25) AS q1, QUANTILE_CONT(sales_qty, 0.75) AS q3 FROM daily GROUP BY 1) USING (product_name)"""
query("cap_iqr", "product_name, date:d, sales_qty:6", lambda t: C.cap_iqr(t.daily), "SELECT * FROM capped")

query("cap_3sigma", "product_name, week_start:d, sales_qty:6", lambda t: C.cap_3sigma(t.panel),
      """SELECT product_name, week_start, CASE WHEN s > 0 THEN LEAST(sales_qty, m + 3 * s) ELSE sales_qty END AS sales_qty FROM panel
         JOIN (SELECT product_name, AVG(sales_qty) AS m, STDDEV_SAMP(sales_qty) AS s FROM panel GROUP BY 1) USING (product_name)""")

query("smooth_blend", "product_name, week_start:d, sales_qty:6", lambda t: C.smooth_blend(t.panel),
      f"""SELECT product_name, week_start, 0.8 * AVG(sales_qty) OVER ({_w} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + 0.2 * sales_qty AS sales_qty FROM panel""")

_sf, _sb = _fb("sales_qty", "date")
query("preprocess_series", "product_name, date:d, sales_qty:6, price, stock_on_hand, promotion:i, holiday_flag:i",
      lambda t: C.preprocess_series(t.daily.select(KEY, "date", "sales_qty", "price", "stock_on_hand", "promotion", "holiday_flag")),
      f"""WITH s AS (SELECT s.product_name, s.date, c.* EXCLUDE (product_name, date) FROM day_spine s LEFT JOIN capped c USING (product_name, date)),
              f AS (SELECT * REPLACE (COALESCE({_sf}, {_sb}, 0) AS sales_qty, COALESCE({_fb('price', 'date')[0]}, QUANTILE_CONT(price, 0.5) OVER (PARTITION BY product_name)) AS price,
                    COALESCE({_fb('stock_on_hand', 'date')[0]}, 0) AS stock_on_hand, COALESCE(promotion, 0) AS promotion, COALESCE(holiday_flag, 0) AS holiday_flag) FROM s)
         SELECT * REPLACE (0.8 * AVG(sales_qty) OVER (PARTITION BY product_name ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + 0.2 * sales_qty AS sales_qty) FROM f""")

CTES["weekly_clean"] = """
WITH w AS (SELECT product_name, date_trunc('week', date) + INTERVAL 6 DAY AS wk, SUM(sales_qty) AS s FROM zero_done GROUP BY 1, 2),
     sp AS (SELECT product_name, UNNEST(generate_series(MIN(wk), MAX(wk), INTERVAL 7 DAY)) AS wk FROM w GROUP BY 1),
     f AS (SELECT product_name, CAST(wk AS DATE) AS date, COALESCE(s, 0) AS q FROM sp LEFT JOIN w USING (product_name, wk)),
     g AS (SELECT *, AVG(q) OVER p AS m, STDDEV_SAMP(q) OVER p AS sd, COUNT(*) OVER p AS weeks FROM f WINDOW p AS (PARTITION BY product_name))
SELECT product_name, date, CASE WHEN sd > 0 THEN LEAST(q, m + 3 * sd) ELSE q END AS sales_qty, weeks FROM g
"""


def twice(t):
    """Every record of a date preceded by a larger one that a later record replaces."""
    rows = zeroed(t)
    return rows.withColumn("seq", F.lit(2)).unionByName(rows.withColumn("sales_qty", F.col("sales_qty") + 1000).withColumn("seq", F.lit(1)))


query("weekly_rejects", "product_name, weeks:i", lambda t: C.weekly_rejects(twice(t), ["seq"], 400),
      "SELECT product_name, MAX(weeks) AS weeks FROM weekly_clean GROUP BY 1 HAVING MAX(weeks) < 400")
query("preprocess_weekly", "product_name, date:d, sales_qty:6", lambda t: C.preprocess_weekly(twice(t), ["seq"]),
      "SELECT product_name, date, sales_qty FROM weekly_clean WHERE weeks >= 8")
