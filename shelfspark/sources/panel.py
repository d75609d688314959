"""The weekly and daily sales panels, rolled up from raw sales lines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.session import delete, files, new_path, shared_dir, written

PART_ROWS = 2_000_000  # about 40 bytes a row: the product side stays under 80 MB when broadcast
_BUILT: dict[tuple, tuple[str, object]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


SUMS = ["qty", "amount", "size_sum", "disc", "n"]


def _sums() -> list:
    return [*[F.sum(c).alias(c) for c in SUMS], F.max("availability").alias("availability")]


def rollup(lineitem: DataFrame, part: DataFrame, grain: str = "week", part_rows: int = PART_ROWS) -> DataFrame:
    """Sales lines to one row per product and week (or day).

    A small product table is broadcast and the lines are summed on the map side, so only
    product-period sums are shuffled. A product table above `part_rows` goes the other
    way: lines are summed per (part, period) first, which caps any hot part at one row per
    period before the join on the part key.
    """
    day = F.col("l_shipdate").cast("date")
    period = day if grain == "day" else F.trunc(day, "week")
    lines = lineitem.select(
        F.col("l_partkey").alias("partkey"),
        period.alias("period"),
        F.col("l_quantity").alias("qty"),
        # whole cents and whole percents: exact sums on primitive longs
        F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("amount"),
        F.floor(F.col("l_discount") * 100 + 0.5).alias("disc"),
        F.col("l_returnflag").alias("weather"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("availability"),
    )
    dim = part.select(
        F.col("p_partkey").alias("partkey"), F.col("p_brand").alias("product_name"), F.col("p_size").alias("size")
    )
    lines = lines.withColumn("n", F.lit(1).cast("bigint"))
    # the text column is a grouping key of the first sum: a maximum of text would turn the
    # hash aggregate over the lines into a sort
    if part.count() <= part_rows:
        joined = lines.join(F.broadcast(dim), "partkey").withColumn("size_sum", F.col("size").cast("bigint"))
    else:
        lines = lines.withColumn("size_sum", F.lit(0).cast("bigint"))
        joined = lines.groupBy("partkey", "period", "weather").agg(*_sums()).join(dim, "partkey")
        joined = joined.withColumn("size_sum", F.col("size") * F.col("n"))
    keys = ["product_name", "period"]
    summed = joined.groupBy(*keys, "weather").agg(*_sums())
    summed = summed.groupBy(*keys).agg(*_sums(), F.max("weather").alias("weather"))
    return summed.select(
        "product_name",
        F.concat(
            F.lit("CAT"), (F.substring("product_name", 7, 20).cast("int") % 5).cast("string")
        ).alias("category"),
        F.col("period").alias("week_start" if grain == "week" else "date"),
        F.col("qty").cast("double").alias("sales_qty"),
        F.try_divide(F.col("amount") / 100, F.col("qty")).alias("price"),
        F.col("size_sum").cast("double").alias("stock_on_hand"),
        F.when(F.col("disc") > 5 * F.col("n"), 1).otherwise(0).alias("promotion"),
        F.when(F.month("period").isin(11, 12), 1).otherwise(0).alias("holiday_flag"),
        "weather",
        "availability",
    )


def _built(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    """Write the rollup once per application and state of its source files; every later query scans the small table."""
    base = sf_dir.rstrip("/")
    state = tuple(x for name in ("lineitem", "part") for x in files(spark, f"{base}/{name}.parquet"))
    key = (spark.sparkContext.applicationId, base, grain, state)
    if key not in _BUILT:
        df = rollup(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), grain)
        path = f"{shared_dir(spark)}/panel-{grain}-{len(_BUILT)}"
        df.write.mode("overwrite").parquet(path)
        _BUILT[key] = (path, df.schema)
    path, schema = _BUILT[key]
    return spark.read.schema(schema).parquet(path)


def _period(grain: str):
    day = F.col("l_shipdate").cast("date")
    return day if grain == "day" else F.trunc(day, "week")


def _manifests(spark: SparkSession, target: str) -> list[int]:
    found = (re.search(r"/manifest-([0-9]+)/[^/]*$", f) for f, _, _ in files(spark, target))
    return sorted({int(m[1]) for m in found if m})


def refresh_panel(spark: SparkSession, source: str, part: DataFrame, target: str, grain: str = "week") -> dict:
    """Bring the stored rollup at `target` up to the files of sales lines at `source`; returns what was done.

    `target` holds the rollup, a folder per period, and a manifest with a row per source file: its path, size, time of change and the
    periods it has lines of. New, changed and deleted files are found by comparing the listing with the manifest. Only
    periods that such a file has or had are rolled up again, from the files that have them, and only their folders are
    overwritten. The manifest is written last: a refresh that broke off is done again by the next one, with the same result.
    The product table is taken as it is now; after a change of it, start a new target.
    """
    source, target = source.rstrip("/"), target.rstrip("/")
    listed = spark.createDataFrame(files(spark, source), "file string, size long, time long")
    done = _manifests(spark, target)
    none = spark.createDataFrame([], "file string, size long, time long, periods array<date>")
    old = spark.read.parquet(f"{target}/manifest-{done[-1]}") if done else none
    same = listed.join(old, ["file", "size", "time"]).select("file", "size", "time", "periods")
    fresh = [r["file"] for r in listed.join(same, "file", "left_anti").select("file").collect()]
    left = old.join(same, "file", "left_anti")
    before = {r["p"] for r in left.select(F.explode("periods").alias("p")).distinct().collect()}  # bounded by the calendar
    if not fresh and left.isEmpty() and done:
        return {"files": 0, "periods": [], "read": 0}
    found = none
    if fresh:
        lines = spark.read.parquet(*fresh).select(F.col("_metadata.file_path").alias("at"), _period(grain).alias("p"))
        held = lines.where("p IS NOT NULL").groupBy("at").agg(F.collect_set("p").alias("periods"))
        plain = lambda c: F.regexp_replace(c, "^([a-z0-9]+):/+", "$1:/")
        news = listed.join(same, "file", "left_anti")
        found = news.join(held, plain(F.col("file")) == plain(F.col("at")), "left").select(
            "file", "size", "time", F.coalesce("periods", F.array().cast("array<date>")).alias("periods")
        )
    now = written(same.unionByName(found), "manifest")
    after = {r["p"] for r in now.join(same, "file", "left_anti").select(F.explode("periods").alias("p")).distinct().collect()}
    touched = sorted(before | after)
    read = 0
    if touched:
        hit = now.where(F.arrays_overlap("periods", F.array(*[F.lit(p) for p in touched]))).select("file", "periods")
        having = [r["file"] for r in hit.select("file").collect()]
        present = {r["p"] for r in hit.select(F.explode("periods").alias("p")).distinct().collect()}
        read = len(having)
        if having:
            days = F.col("l_shipdate").cast("date")
            near = days.between(F.lit(touched[0]), F.date_add(F.lit(touched[-1]), 6))
            lines = spark.read.parquet(*having).where(near & _period(grain).isin(touched))
            rolled = rollup(lines, part, grain)
            stored = rolled.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            stored.partitionBy("week_start" if grain == "week" else "date").parquet(f"{target}/data")
        for p in touched:
            if p not in present:
                delete(spark, f"{target}/data/{'week_start' if grain == 'week' else 'date'}={p}")
    version = done[-1] + 1 if done else 0
    now.write.parquet(f"{target}/manifest-{version}")
    for v in done[:-1]:
        delete(spark, f"{target}/manifest-{v}")
    return {"files": len(fresh), "periods": touched, "read": read}


def stored_panel(spark: SparkSession, target: str, grain: str = "week") -> DataFrame:
    """The rollup that `refresh_panel` keeps at `target`."""
    time = "week_start" if grain == "week" else "date"
    cols = ["product_name", "category", time, "sales_qty", "price", "stock_on_hand", "promotion", "holiday_flag", "weather", "availability"]
    return spark.read.parquet(f"{target.rstrip('/')}/data").withColumn(time, F.col(time).cast("date")).select(*cols)


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product and Monday week."""
    return _built(spark, sf_dir, "week")


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per product and day."""
    return _built(spark, sf_dir, "day")


class Tables:
    """The tables a query may read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def panel(self) -> DataFrame:
        return weekly_panel(self.spark, self.sf_dir)

    @property
    def daily(self) -> DataFrame:
        return daily_panel(self.spark, self.sf_dir)

    @property
    def lines(self) -> DataFrame:
        return rollup(self.lineitem, self.part)
