"""Whole-column statistics on their large-data paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.functions import stats


def values(spark, n, kind):
    x = F.rand(7) if kind == "uniform" else F.exp(F.randn(7) * 3) if kind == "heavy" else F.when(F.rand(7) < 0.4, 5.0).otherwise(F.rand(8))
    return spark.range(n).select("id", x.alias("x")).cache()


@pytest.mark.parametrize("kind", ["uniform", "heavy", "hot"])
@pytest.mark.parametrize("n", [1, 2, 3, 799, 801, 60_000])
def test_quantiles_match_numpy(spark, kind, n):
    df = values(spark, n, kind)
    got = {r.prob: r.value for r in stats.quantiles(df, ["x"], [0.0, 0.1, 0.5, 0.95, 1.0]).collect()}
    x = np.array([r.x for r in df.select("x").collect()])
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12)
    assert len(got) == 5


def test_quantiles_small_and_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (None, 7.0)], "a double, b double")
    row = stats.median_row(df, ["a", "b"]).first()
    assert (row.a, row.b) == (1.5, 6.0)


def test_fill_median_keeps_known_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "a double")
    assert sorted(r.a for r in stats.fill_median(df, ["a"]).collect()) == [1.0, 2.5, 4.0]


def test_ranked_values_split_in_many_ranges(spark):
    df = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("v"), F.lit("one").alias("w"))
    got = {(r.name, r.value): r.code for r in stats.ranked_values(df, ["v", "w"], cuts=16).collect()}
    want = {("v", v): i for i, v in enumerate(sorted(f"k{i}" for i in range(5000)))} | {("w", "one"): 0}
    assert got == want


def test_sized_join_both_ways(spark):
    left = spark.range(1000).select((F.col("id") % 3).alias("k"))
    side = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    small = stats.sized_join(left, side, "k").groupBy("v").count().collect()
    large = stats.sized_join(left, side, "k", max_rows=1).groupBy("v").count().collect()
    assert sorted(map(str, small)) == sorted(map(str, large))


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 2.0, 5.0), (3.0, 2.0, 4.0)], "a double, b double, c double")
    r = df.agg(stats.corr("a", "b").alias("ab"), stats.corr("a", "c").alias("ac")).first()
    assert r.ab is None and r.ac == pytest.approx(0.5)


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert df.limit(1).select(stats.mode_of(df, "v")).first()[0] == "a"


@pytest.mark.parametrize("shape", ["spread", "ties", "two heaps", "one value"])
def test_narrowed_brackets_are_exact(spark, shape):
    n = 300_000
    value = {
        "spread": F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double"),
        "ties": F.pmod(F.xxhash64("id"), F.lit(37)).cast("double"),
        # nearly all rows are 1 or 2, the rest lies between them: the median's bracket has many values and few rows
        "two heaps": F.when(F.col("id") < n * 0.495, 1.0).when(F.col("id") >= n * 0.505, 2.0).otherwise(1 + F.col("id") / n),
        "one value": F.lit(4.0),
    }[shape]
    df = spark.range(n).select(value.alias("v"), F.when(F.col("id") < 5, F.col("id").cast("double")).alias("w")).cache()
    probs = [0.0, 0.1, 0.4951, 0.5, 0.9999, 1.0]
    got = {(r.name, r.prob): r.value for r in stats.quantiles(df, ["v", "w"], probs, most=1).collect()}
    whole = df.agg(*[F.percentile("v", F.lit(p)) for p in probs], *[F.percentile("w", F.lit(p)) for p in probs]).first()
    assert [got["v", p] for p in probs] == pytest.approx(list(whole[:6]), rel=1e-12)
    assert [got["w", p] for p in probs] == pytest.approx(list(whole[6:]), rel=1e-12)


def test_ten_million_values_leave_few_to_rank(spark):
    vals = spark.range(10_000_000).select(F.pmod(F.col("id") * 7919, F.lit(10_000_019)).cast("double").alias("v0"))
    b = {"col": "v0", "prob": 0.5, "n": 10_000_000, "lo": 0.0, "hi": 1e7 + 19, "room": 10_000_000}
    stats._narrow(vals, [b], 1000)
    inside = vals.where((F.col("v0") > b["lo"]) & (F.col("v0") < b["hi"])).count()
    assert inside <= 1000
    exact = vals.agg(F.count_if(F.col("v0") < b["lo"]).alias("below"), F.count_if(F.col("v0") <= b["hi"]).alias("upto")).first()
    assert exact.below <= 4_999_999 and exact.upto >= 5_000_001
