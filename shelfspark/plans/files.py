"""Source and sink queries. Files are written from the given tables into the shared work folder."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY, TIME
from shelfspark.operators import inventory as I
from shelfspark.plans.registry import query
from shelfspark.session import new_path
from shelfspark.sources import files as S
from shelfspark.sources.panel import refresh_panel, stored_panel

SMALL = "product_name, week_start:d, sales_qty, price, promotion:i"
COLS = [KEY, TIME, "sales_qty", "price", "promotion"]
SQL = "SELECT product_name, week_start, sales_qty, price, promotion FROM panel"


def _csv(t):
    path = new_path(t.spark, "scan-csv")
    t.panel.select(*COLS).write.option("header", True).csv(path)
    return S.scan_csv(t.spark, path, t.panel.select(*COLS).schema)


def _inferred(t):
    path = new_path(t.spark, "infer-csv")
    t.panel.select(*COLS).write.option("header", True).csv(path)
    return S.scan_csv(t.spark, path)


query("scan_csv", SMALL, _csv, SQL)
query("scan_csv_inferred", SMALL, _inferred, SQL)
query("scan_parquet", "o_orderkey:i, o_custkey:i, o_orderstatus, o_totalprice", lambda t: S.scan_parquet(t.spark, f"{t.sf_dir.rstrip('/')}/orders.parquet"),
      "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")


def messy(t):
    """The panel as an upload with odd headers, day-first dates and text in the quantity."""
    qty = F.when(F.col("promotion") == 1, F.col("sales_qty").cast("bigint").cast("string")).otherwise(F.col("sales_qty").cast("string"))
    odd = (F.col("holiday_flag") == 1) & (F.col("promotion") == 1)
    out = t.panel.select(
        F.date_format(TIME, "dd/MM/yyyy").alias("Week-Start"), F.date_format(TIME, "yyyy").alias("Year / Week"),
        F.col(KEY).alias(" Item Name"), F.when(odd, "sold out").otherwise(qty).alias("Order Quantity"),
        F.col("price").alias("Unit Price"), F.col("category").alias("Dept"),
    )
    path = new_path(t.spark, "upload")
    out.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return path


query("ingest_canonical", "date:d, product, sales_qty, price, stock_on_hand, category, store", lambda t: S.ingest_canonical(t.spark, messy(t)),
      """WITH m AS (SELECT week_start, strftime(week_start, '%d/%m/%Y') AS s, * EXCLUDE (week_start) FROM panel),
              d AS (SELECT *, CAST(try_strptime(s, '%m/%d/%Y') AS DATE) AS md FROM m)
         SELECT CASE WHEN (SELECT AVG(CASE WHEN md IS NULL THEN 1.0 ELSE 0.0 END) FROM d) > 0.5 THEN week_start ELSE md END AS date, product_name AS product,
                CASE WHEN holiday_flag = 1 AND promotion = 1 THEN 0 ELSE sales_qty END AS sales_qty, price, CAST(NULL AS DOUBLE) AS stock_on_hand, category, CAST(NULL AS VARCHAR) AS store FROM d""")



def quoted(t, folder):
    """The panel as uploads of two layouts, several files each: product names with quotes, commas and line breaks, written by the usual rules."""
    name = F.concat(KEY, F.lit(' "fresh", 1l\nbox'))
    day, qty = F.date_format(TIME, "yyyy-MM-dd"), F.col("sales_qty").cast("bigint").cast("string")
    layouts = {1: [day.alias("Date"), name.alias("Product"), qty.alias("Qty")], 0: [name.alias("Item Name"), qty.alias("Order Quantity"), day.alias("Date")]}
    for part, cols in layouts.items():
        lines = t.panel.where(F.col("promotion") == part).repartition(4, KEY, TIME).select(*cols)
        lines.write.option("header", True).option("escape", '"').csv(f"{folder}/part={part}")
    return [f"{folder}/part={part}" for part in layouts]


def _quoted(t):
    folder = new_path(t.spark, "quoted")
    return S.ingest_canonical(t.spark, quoted(t, folder)[0], lines=True)


def _many(t):
    folder = new_path(t.spark, "headers")
    quoted(t, folder)
    return S.ingest_canonical(t.spark, f"{folder}/*", lines=True)


CANON = "date:d, product, sales_qty:6"
NAME = """product_name || ' "fresh", 1l' || chr(10) || 'box' AS product"""
query("ingest_quoted", CANON, _quoted, f"SELECT week_start AS date, {NAME}, CAST(CAST(sales_qty AS BIGINT) AS DOUBLE) AS sales_qty FROM panel WHERE promotion = 1")
query("ingest_many_headers", CANON, _many, f"SELECT week_start AS date, {NAME}, CAST(CAST(sales_qty AS BIGINT) AS DOUBLE) AS sales_qty FROM panel")


def _rejects(t):
    """An upload whose holiday weeks have no date and whose promoted weeks have no product."""
    path = new_path(t.spark, "rejects")
    bad = t.panel.select(F.when(F.col("holiday_flag") == 1, "n/a").otherwise(F.col(TIME).cast("string")).alias("Date"),
                         F.when(F.col("promotion") == 0, F.col(KEY)).alias("Product"), F.col("sales_qty").alias("Qty"))
    bad.write.option("header", True).csv(path)
    return S.ingest_rejects(S.ingest_canonical(t.spark, path))


query("ingest_rejects", "date:d, product, sales_qty, reason", _rejects,
      """SELECT CASE WHEN holiday_flag <> 1 THEN week_start END AS date, CASE WHEN promotion = 0 THEN product_name END AS product, sales_qty,
                CASE WHEN holiday_flag = 1 THEN 'date' ELSE 'product' END AS reason FROM panel WHERE holiday_flag = 1 OR promotion = 1""")

query("sink_csv", SMALL, lambda t: S.sink_csv(t.panel.select(*COLS), new_path(t.spark, "sink-csv")), SQL)
query("sink_json", "product_name, urgency, current_stock, weeks_remaining:6, suggested_order:i",
      lambda t: S.sink_json(I.alerts_weeks(t.panel).select(KEY, "urgency", "current_stock", "weeks_remaining", "suggested_order"), new_path(t.spark, "sink-json")),
      "SELECT product_name, urgency, current_stock, weeks_remaining, suggested_order FROM al_weeks")
query("sink_by_product", SMALL, lambda t: S.sink_by_product(t.panel.select(*COLS), new_path(t.spark, "by-product")), SQL)


def _fresh(t):
    """Two batches of files; only the ones written after the run started are read."""
    path = new_path(t.spark, "fresh")
    t.panel.select(*COLS).filter("promotion = 1").write.parquet(f"{path}/run=1")
    started = datetime.datetime.now(datetime.timezone.utc)
    t.panel.select(*COLS).filter("promotion = 0").write.parquet(f"{path}/run=2")
    return S.fresh_files(t.spark, path, started)


query("fresh_files", SMALL, _fresh, SQL + " WHERE promotion = 0")


# ---- a rollup that follows its source files


def followed(t):
    """The weekly panel after its source got new files and corrected ones, a file per task that reads lines; refreshed from a first state that lacked both."""
    source, target = new_path(t.spark, "lines"), new_path(t.spark, "followed")
    lines = t.lineitem.withColumn("year", F.year("l_shipdate"))
    late = (F.col("year") >= 2000) & (F.col("l_orderkey") % 4 == 0)
    put = lambda rows, name: rows.drop("year").write.mode("overwrite").parquet(f"{source}/{name}")
    put(lines.where(F.col("year") < 1999), "first")
    put(lines.where((F.col("year") >= 1999) & ~late).withColumn("l_quantity", F.col("l_quantity") + 1), "wrong")
    refresh_panel(t.spark, source, t.part, target)
    put(lines.where((F.col("year") >= 1999) & ~late), "wrong")
    put(lines.where(late), "more")
    refresh_panel(t.spark, source, t.part, target)
    return stored_panel(t.spark, target)


query("panel_refreshed", "product_name, category, week_start:d, sales_qty, price:6, stock_on_hand, promotion:i, holiday_flag:i, weather, availability:i", followed, "SELECT * FROM panel")
