"""Local regression: exact on lines, hardly moved by outliers."""

import datetime
import math

from pyspark.sql import functions as F

from shelfspark.operators.forecast import decompose_additive, decompose_robust

DAY = datetime.date(2024, 1, 1)
WAVE = [0.0, 4.0, -2.0, 1.0, 3.0, -5.0, -1.0]  # sums to 0


def series(spark, values, name="a"):
    return spark.createDataFrame([(name, DAY + datetime.timedelta(days=i), float(v)) for i, v in enumerate(values)], "product_name string, date date, sales_qty double")


def trends(df):
    return {r.date: r.trend for r in df.collect() if r.trend is not None}


def test_line_and_wave_are_told_apart(spark):
    rows = decompose_robust(series(spark, [20 + 0.5 * i + WAVE[i % 7] for i in range(70)]), 7, inner=4, robust=0).collect()
    assert len(rows) == 70
    middle = [r for r in rows if 10 <= (r.date - DAY).days < 60]
    assert all(abs(r.trend - (20 + 0.5 * (r.date - DAY).days)) < 0.2 for r in middle)
    assert all(abs(r.resid) < 0.2 for r in middle)


def test_outlier_moves_the_robust_trend_less(spark):
    plain = [50 + WAVE[i % 7] + 0.3 * math.sin(i * 1.7) for i in range(84)]
    spiked = [v + (400 if i == 40 else 0) for i, v in enumerate(plain)]

    def moved(f):
        a, b = trends(f(series(spark, plain))), trends(f(series(spark, spiked)))
        return max(abs(a[d] - b[d]) for d in a)

    robust, additive = moved(lambda s: decompose_robust(s, 7, inner=1, robust=2)), moved(decompose_additive)
    assert additive > 50
    assert robust < additive / 5
    weights = {(r.date - DAY).days: r.weight for r in decompose_robust(series(spark, spiked), 7, inner=1, robust=2).collect()}
    assert weights[40] < 1e-4 and min(w for i, w in weights.items() if abs(i - 40) > 20) > 0.3


def test_products_stand_alone_and_short_ones_go(spark):
    a, b = series(spark, range(30), "a"), series(spark, [7 * (i % 7) for i in range(30)], "b")
    both = decompose_robust(a.unionByName(b).unionByName(series(spark, range(13), "short")))
    alone = decompose_robust(a)
    assert {r.product_name for r in both.collect()} == {"a", "b"}
    assert sorted(both.where("product_name = 'a'").collect()) == sorted(alone.collect())


def test_constant_and_short_periods(spark):
    flat = decompose_robust(series(spark, [5.0] * 20), 52, min_n=10).collect()  # period 10
    assert all(abs(r.trend - 5) < 1e-9 and abs(r.seasonal) < 1e-9 and r.weight == 1 for r in flat)
    assert decompose_robust(series(spark, [1.0]).where(F.lit(False))).collect() == []
