"""Streams drained in several batches equal the batch result."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfspark.session import new_path
from shelfspark.streaming import jobs as J


def stream_of(spark, df, parts, order):
    """Files in time order, one per batch."""
    path = new_path(spark, "in")
    edges = [r[0] for r in df.select(order).distinct().orderBy(order).collect()]
    size = -(-len(edges) // parts)
    for i in range(0, len(edges), size):
        df.filter(F.col(order).between(edges[i], edges[min(i + size, len(edges)) - 1])).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def outcomes(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("hot" if i % 3 else f"s{i % 5}", i % 2, t0 + datetime.timedelta(hours=5 * i), float(1000 + i % 37)) for i in range(240)]
    return spark.createDataFrame(rows, "state string, step int, ts timestamp, revenue double")


@pytest.mark.parametrize("parts", [1, 4])
def test_price_learning_equals_the_loop(spark, parts):
    df = outcomes(spark)
    got = {(r.state, r.step): (r.value, r.updates) for r in J.stream_price_learning(stream_of(spark, df, parts, "ts"), 0.05).collect()}
    want = {}
    for r in df.orderBy("ts").collect():
        v, n = want.get((r.state, r.step), (0.0, 0))
        want[r.state, r.step] = (v + 0.05 * (r.revenue / 1000 - v), n + 1)
    assert set(got) == set(want)
    for k, (v, n) in want.items():
        assert got[k][1] == n and got[k][0] == pytest.approx(v, rel=1e-12)


def test_running_counts_over_batches(spark):
    df = outcomes(spark).select(F.col("state").alias("product_id"), F.col("step").alias("price"), "revenue", F.lit(1.0).alias("demand"), "ts")
    out = J.drain(J.stream_ab_results(stream_of(spark, df, 5, "ts")), "update", ("product_id", "price"))
    got = {(r.product_id, r.price): (r.n, r.revenue) for r in out.collect()}
    want = {(r.product_id, r.price): (r.n, r.revenue) for r in df.groupBy("product_id", "price").agg(F.count("*").alias("n"), F.sum("revenue").alias("revenue")).collect()}
    assert got == want


def test_late_rows_are_dropped_and_open_week_waits(spark):
    t0 = datetime.datetime(2024, 1, 1)
    day = datetime.timedelta(days=1)
    rows = [(1, t0, "a", 1.0), (2, t0 + 8 * day, "a", 2.0), (3, t0 + 20 * day, "a", 4.0)]
    middle = [(6, t0 + 20 * day, "a", 1.0)]  # late rows are judged by the watermark of the batch before
    late = [(4, t0 + 1 * day, "a", 100.0), (5, t0 + 21 * day, "a", 8.0)]
    path = new_path(spark, "late")
    schema = "event_id long, ts timestamp, event_type string, value double"
    for part in (rows, middle, late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.week_start: r.sales_qty for r in J.drain(J.stream_weekly_sales(stream)).collect()}
    assert got == {datetime.date(2024, 1, 1): 1.0, datetime.date(2024, 1, 8): 2.0}


def test_learning_goes_on_in_a_new_call(spark):
    df = outcomes(spark).orderBy("ts")
    days = [r[0] for r in df.select("ts").distinct().orderBy("ts").collect()]
    path, folder = new_path(spark, "resume"), new_path(spark, "resume-state")
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    cuts = [0, 60, 110, 170, len(days)]
    for first, last in ((0, 2), (2, 4)):
        for i in range(first, last):
            df.filter(F.col("ts").between(days[cuts[i]], days[cuts[i + 1] - 1])).coalesce(1).write.mode("append").parquet(path)
        got = J.stream_price_learning(stream(), 0.05, folder)
    again = J.stream_price_learning(stream(), 0.05, folder)  # nothing new
    whole = J.stream_price_learning(stream_of(spark, df, 1, "ts"), 0.05)
    rows = lambda d: sorted((r.state, r.step, round(r.value, 9), r.updates) for r in d.collect())
    assert rows(got) == rows(again) == rows(whole)
    assert J.newest_version(spark, f"{folder}/state") == 3


def test_append_goes_on_in_a_new_call(spark):
    t0, day = datetime.datetime(2024, 1, 1), datetime.timedelta(days=1)
    path, folder, schema = new_path(spark, "more"), new_path(spark, "more-out"), "event_id long, ts timestamp, event_type string, value double"
    for part in ([(1, t0, "a", 1.0), (2, t0 + 9 * day, "a", 2.0)], [(3, t0 + 10 * day, "a", 4.0), (4, t0 + 30 * day, "a", 8.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        out = J.drain(J.stream_weekly_sales(spark.readStream.schema(schema).parquet(path)), folder=folder)
    assert {r.week_start: r.sales_qty for r in out.collect()} == {datetime.date(2024, 1, 1): 1.0, datetime.date(2024, 1, 8): 6.0}
