"""Structured Streaming forms of the incremental operators.

A stream is a DataFrame with ts (timestamp), product_id and the measures. Each job only
declares the stream; `drain` runs it to the end of the available input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.session import new_path

MONDAY = "4 days"  # the epoch was a Thursday


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The event table as a stream: user as key, value as quantity, ts as event time."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a pattern, because the file source wants a folder or a pattern and the table may be one file
    df = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_weekly_sales(stream: DataFrame, delay: str = "1 day", key: str = "event_type") -> DataFrame:
    """Sum per key and Monday week; a week is emitted once the watermark has passed it."""
    w = F.window("ts", "7 days", "7 days", MONDAY)
    out = stream.withWatermark("ts", delay).groupBy(w, key).agg(F.sum("value").alias("sales_qty"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").cast("date").alias("week_start"), key, "sales_qty", "n")


def stream_rolling_sales(stream: DataFrame, delay: str = "1 day", key: str = "event_type") -> DataFrame:
    """4-week total and weekly mean per key on windows that slide by a week."""
    w = F.window("ts", "28 days", "7 days", MONDAY)
    out = stream.withWatermark("ts", delay).groupBy(w, key).agg(F.sum("value").alias("total"))
    return out.select(
        F.col("window.start").cast("date").alias("from_week"), key, "total", (F.col("total") / 4).alias("weekly_mean")
    )


def stream_ab_results(stream: DataFrame) -> DataFrame:
    """Running count and revenue per (product, price)."""
    return stream.groupBy("product_id", "price").agg(
        F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("revenue"), F.sum("demand").alias("demand")
    )


def stream_dedupe(stream: DataFrame, delay: str = "1 day", keys=("user_id", "day")) -> DataFrame:
    """The first record per key and day within the watermark."""
    return stream.withColumn("day", F.date_trunc("day", "ts")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def stream_bandit_counts(stream: DataFrame) -> DataFrame:
    """Wins and losses per (product, price): a sale wins above 80 % of the expected revenue."""
    won = F.col("revenue") > F.col("price") * F.col("forecast") * 0.8
    return stream.groupBy("product_id", "price").agg(F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"))


def folded(batch: DataFrame, lr: float, slice_width: str = "hour") -> DataFrame:
    """One batch of outcomes as (state, step, n, gain): what n updates in event-time order add.

    value += lr * (reward - value) makes a row count for lr * (1 - lr)^(rows after it), and such
    sums combine. Rows are ranked inside short time slices, so a hot key is spread over its
    slices, and only one row per slice is ordered per key.
    """
    keep = 1 - lr
    rows = batch.withColumn("slice", F.date_trunc(slice_width, "ts"))
    late = Window.partitionBy("state", "step", "slice").orderBy(F.col("ts").desc(), F.col("revenue").desc())
    rows = rows.withColumn("after", F.row_number().over(late) - 1)
    slices = rows.groupBy("state", "step", "slice").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("revenue") / 1000.0 * F.pow(F.lit(keep), F.col("after"))).alias("s")
    )
    later = Window.partitionBy("state", "step").orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("later", F.coalesce(F.sum("n").over(later), F.lit(0)))
    return slices.groupBy("state", "step").agg(
        F.sum("n").alias("n"), (lr * F.sum(F.col("s") * F.pow(F.lit(keep), F.col("later")))).alias("gain")
    )


def _files(spark: SparkSession, path: str):
    """File system and path object of a path, whatever its scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def newest_version(spark: SparkSession, folder: str) -> int:
    """Largest n of the finished versions v{n} in a folder, -1 without any."""
    fs, at = _files(spark, f"{folder}/v*/_SUCCESS")
    return max((int(s.getPath().getParent().getName()[1:]) for s in fs.globStatus(at) or []), default=-1)


def stream_price_learning(stream: DataFrame, lr: float = 0.01, folder: str | None = None) -> DataFrame:
    """Learned value per (state, price step): value += lr * (revenue / 1000 - value) for every outcome.

    The keyed state is a small table written per batch under `folder`, next to the checkpoint. A
    repeated batch rewrites its own version from the one before it, and a new call with the same
    folder goes on where the last one ended, so a restart neither loses nor repeats updates. The two
    newest versions are kept. Without a folder every call starts afresh.
    """
    spark = stream.sparkSession
    folder = folder or new_path(spark, "learned")
    out, check = f"{folder}/state", f"{folder}/checkpoint"
    schema = "state string, step int, value double, updates long"

    def before(epoch: int) -> DataFrame:
        if epoch == 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{out}/v{epoch - 1}")

    def learn(batch: DataFrame, epoch: int) -> None:
        new = folded(batch, lr)
        both = before(epoch).join(new, ["state", "step"], "full")
        n = F.coalesce("n", F.lit(0))
        value = F.coalesce("value", F.lit(0.0)) * F.pow(F.lit(1 - lr), n) + F.coalesce("gain", F.lit(0.0))
        kept = both.select("state", "step", value.alias("value"), (F.coalesce("updates", F.lit(0)) + n).alias("updates"))
        kept.write.mode("overwrite").parquet(f"{out}/v{epoch}")
        fs, old = _files(spark, f"{out}/v{epoch - 2}")
        fs.delete(old, True)

    query = (
        stream.writeStream.foreachBatch(learn).option("checkpointLocation", check).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return before(newest_version(spark, out) + 1)


def drain(result: DataFrame, mode: str = "append", keys: tuple[str, ...] = (), folder: str | None = None) -> DataFrame:
    """Run a stream over the input that is there and return what it wrote.

    Append mode goes to the Parquet sink. Update and complete mode write each batch to its
    own folder; the newest row per key (or the newest batch) is the result. Nothing passes
    through the driver, and the checkpoint lies in the shared folder. A later call with the same
    `folder` reads only what came since and returns the result of all calls.
    """
    spark = result.sparkSession
    folder = folder or new_path(spark, "stream")
    out, check = f"{folder}/out", f"{folder}/checkpoint"
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        def save(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

        query = writer.foreachBatch(save).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(result.schema).parquet(out)
    fields = T.StructType([*result.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(fields).parquet(out)
    if mode == "complete":
        newest = rows.agg(F.max("batch").alias("b")).scalar()
        return rows.filter(F.col("batch") == newest).drop("batch")
    rest = [c for c in result.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
