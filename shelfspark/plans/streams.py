"""Streaming queries: the given tables as file streams, drained to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY, TIME
from shelfspark.functions.stats import sized_join
from shelfspark.operators import strategies as S
from shelfspark.operators.windows import change
from shelfspark.plans.pricing import STATE_SQL, price_tests
from shelfspark.plans.registry import query
from shelfspark.session import new_path
from shelfspark.streaming import jobs as J


def events(t):
    return J.event_stream(t.spark, f"{t.sf_dir.rstrip('/')}/events.parquet")


def as_stream(t, df, files: int = 4, per_batch: int | None = 2):
    """A table written as a few files and read back as a stream, `per_batch` files at a time."""
    path = new_path(t.spark, "stream-in")
    df.repartition(files).write.parquet(path)
    reader = t.spark.readStream.schema(df.schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(path)


# append mode emits only closed weeks: those that end at or before the newest event less the delay
query("stream_weekly_sales", "week_start:d, event_type, sales_qty:2, n:i", lambda t: J.drain(J.stream_weekly_sales(events(t))),
      """SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, event_type, SUM(CAST(value AS DECIMAL(18,2))) AS sales_qty, COUNT(*) AS n FROM events
         WHERE date_trunc('week', ts) + INTERVAL 7 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""")

query("stream_rolling_sales", "from_week:d, event_type, total:2, weekly_mean:4", lambda t: J.drain(J.stream_rolling_sales(events(t))),
      """SELECT CAST(date_trunc('week', ts) - INTERVAL (7 * i) DAY AS DATE) AS from_week, event_type, SUM(CAST(value AS DECIMAL(18,2))) AS total, SUM(CAST(value AS DECIMAL(18,2))) / 4 AS weekly_mean
         FROM events, range(4) r(i) WHERE date_trunc('week', ts) - INTERVAL (7 * i) DAY + INTERVAL 28 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2""")

query("stream_ab_results", "product_id, price:i, n:i, demand:2, revenue:4",
      lambda t: J.drain(J.stream_ab_results(as_stream(t, price_tests(t))), "update", ("product_id", "price")),
      "SELECT product_id, price, COUNT(*) AS n, SUM(demand) AS demand, SUM(revenue) AS revenue FROM tests GROUP BY 1, 2")


def _sales(t):
    """Past sales as outcomes: the product's mean quantity is the forecast."""
    mean = t.panel.groupBy(KEY).agg(F.avg("sales_qty").alias("forecast"))
    return t.panel.join(mean, KEY).select(
        F.col(KEY).alias("product_id"), F.round("price", 0).alias("price"), "forecast", (F.col("price") * F.col("sales_qty")).alias("revenue"))


query("stream_bandit_counts", "product_id, price, wins:i, losses:i",
      lambda t: J.drain(J.stream_bandit_counts(as_stream(t, _sales(t))), "update", ("product_id", "price")),
      """WITH s AS (SELECT product_name AS product_id, ROUND(price, 0) AS price, AVG(sales_qty) OVER (PARTITION BY product_name) AS f, price * sales_qty AS revenue FROM panel)
         SELECT product_id, price, COUNT(*) FILTER (revenue > price * f * 0.8) AS wins, COUNT(*) FILTER (revenue <= price * f * 0.8) AS losses FROM s GROUP BY 1, 2""")


def _outcomes(t):
    """Every week as a state, the price step it took and the revenue it brought."""
    cat = t.panel.groupBy("category").agg(F.avg("price").alias("competitor_price"))
    rows = sized_join(t.panel.withColumn("price_change", change("price")).filter("price_change IS NOT NULL"), cat, "category", "inner")
    rows = rows.withColumns({"current_stock": F.col("stock_on_hand"), "demand_forecast": F.col("sales_qty"), "current_price": F.col("price")})
    step = F.greatest(F.lit(0.0), F.least(F.lit(6.0), F.round(F.col("price_change") / 0.05) + 3)).cast("int")
    return rows.select(S.state_of().alias("state"), step.alias("step"), F.col(TIME).cast("timestamp").alias("ts"),
                       (F.col("price") * F.col("sales_qty")).alias("revenue"))


# one batch holds all files, so the updates run in event-time order over the whole table
query("stream_price_learning", "state, step:i, value:6, updates:i", lambda t: J.stream_price_learning(as_stream(t, _outcomes(t), per_batch=None)),
      f"""WITH h AS (SELECT week_start, stock_on_hand AS stock, sales_qty AS qty, price, cp, price / LAG(price) OVER (PARTITION BY product_name ORDER BY week_start) - 1 AS dp
                     FROM panel JOIN (SELECT category, AVG(price) AS cp FROM panel GROUP BY 1) USING (category)),
               s AS (SELECT {STATE_SQL} AS state, GREATEST(0, LEAST(6, ROUND(dp / 0.05) + 3)) AS step, week_start, price * qty AS revenue FROM h WHERE dp IS NOT NULL),
               r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY state, step ORDER BY week_start DESC, revenue DESC) - 1 AS after FROM s)
          SELECT state, step, SUM(0.01 * revenue / 1000 * POW(0.99, after)) AS value, COUNT(*) AS updates FROM r GROUP BY 1, 2""")

query("stream_dedupe", "user_id:i, day:d, n:i",
      lambda t: J.drain(J.stream_dedupe(events(t))).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n")),
      "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, 1 AS n FROM events")
