"""Least squares and Gram matrices against numpy."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.functions.linear import cholesky, correlations, least_squares, substituted
from shelfspark.operators import forecast as O


def test_triangles_and_solutions(spark):
    rng = np.random.default_rng(1)
    for size in (1, 2, 5, 12):
        m = rng.normal(size=(size + 3, size))
        a, b = m.T @ m + 0.1 * np.eye(size), rng.normal(size=size)
        df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<array<double>>, b array<double>")
        low = cholesky(F.col("a"), size)
        r = df.withColumn("l", low).withColumn("x", substituted(F.col("l"), F.col("b"), size)).first()
        assert [len(x) for x in r.l] == list(range(1, size + 1)) and np.allclose(r.x, np.linalg.solve(a, b))
        assert np.allclose([v for row in r.l for v in row], np.linalg.cholesky(a)[np.tril_indices(size)])


def test_coefficients_per_key(spark):
    rng = np.random.default_rng(2)
    x, key = rng.normal(size=(400, 4)), rng.integers(0, 3, 400)
    x[:, 3] = 0  # a feature without values
    y = x @ [1.0, -2.0, 0.5, 9.0] + key + 0.01 * rng.normal(size=400)
    df = spark.createDataFrame([(int(k), v.tolist(), float(t)) for k, v, t in zip(key, x, y)], "k int, x array<double>, y double").repartition(7)
    got = {r.k: r.coef for r in least_squares(df, ["k"], F.col("x"), F.col("y"), 4, [0.1] * 4).collect()}
    for k in range(3):
        xs, ys = x[key == k], y[key == k]
        assert np.allclose(got[k], np.linalg.solve(xs.T @ xs + 0.1 * np.eye(4), xs.T @ ys))
    text = df.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    plan = least_squares(df, ["k"], F.col("x"), F.col("y"), 4, [0.1] * 4)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "Python" not in plan and text


def test_pairwise_correlations(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(300, 20)) + 1e6, columns=[f"c{i}" for i in range(20)])
    pdf["c1"] = pdf["c0"] * 2 + rng.normal(size=300)
    pdf["c2"] = 5.0
    pdf = pdf.mask(rng.random(pdf.shape) < 0.1)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf.columns))
    want, n = pdf.corr(), pdf.notna().astype(int)
    got = correlations(df, list(pdf.columns)).collect()
    assert len(got) == 400
    for r in got:
        assert r.n == (n[r.a] * n[r.b]).sum()
        assert r.corr is None if "c2" in (r.a, r.b) else r.corr == pytest.approx(want.loc[r.a, r.b], abs=1e-9)


def test_regression_needs_ten_weeks_and_bends(spark):
    rows = [("short", i, 5.0) for i in range(9)] + [("bent", i, 10.0 + (0 if i < 100 else (i - 100) * 0.5)) for i in range(200)] + [("flat", i, 7.0) for i in range(10)]
    df = spark.createDataFrame(rows, "product_name string, i int, sales_qty double").selectExpr(
        "product_name", "date_add(date'2015-01-05', 7 * i) AS week_start", "sales_qty", "0 AS holiday_flag", "0 AS promotion")
    got = {(r.product_name, r.step): r.yhat for r in O.forecast_regression(df, 10, bends=5, terms={}).collect()}
    assert {p for p, _ in got} == {"bent", "flat"} and got["flat", 3] == pytest.approx(7, abs=0.1)
    assert got["bent", 10] == pytest.approx(10 + 109 * 0.5, rel=0.1)


def test_future_holidays_are_an_argument(spark):
    rows = [(i, 100.0 if i % 10 == 0 else 20.0, int(i % 10 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, sales_qty double, holiday_flag int").selectExpr(
        "'a' AS product_name", "date_add(date'2015-01-05', 7 * i) AS week_start", "sales_qty", "holiday_flag", "0 AS promotion")
    on = O.forecast_regression(df, 4, lambda d: (F.datediff(d, F.lit("2015-01-05")) % 70 == 0).cast("int"), terms={}, logs=False).orderBy("step").collect()
    off = O.forecast_regression(df, 4, terms={}, logs=False).orderBy("step").collect()
    assert on[0].yhat > 90 and all(r.yhat < 30 for r in [*on[1:], *off])


def test_arma_finds_its_coefficients_and_falls_back(spark):
    rng = np.random.default_rng(5)
    shock = rng.normal(0, 1, 3000)
    d = np.zeros(3000)
    for t in range(1, 3000):
        d[t] = 0.2 + 0.6 * d[t - 1] + shock[t] + 0.4 * shock[t - 1]
    y = 100 + np.cumsum(d)
    day = datetime.date(1950, 1, 2)
    rows = [("moving", day + datetime.timedelta(weeks=t), float(v)) for t, v in enumerate(y)]
    rows += [("short", day + datetime.timedelta(weeks=t), float(10 + t % 3)) for t in range(10)]
    rows += [("flat", day + datetime.timedelta(weeks=t), 5.0) for t in range(10)] + [("one", day, 5.0), ("void", day, None)]
    panel = spark.createDataFrame(rows, "product_name string, week_start date, sales_qty double")
    out = {(r.product_name, r.step): r for r in O.forecast_arma(panel, 3).collect()}
    assert set(out) == {(p, h) for p in ("moving", "short") for h in (1, 2, 3)}
    first = out["moving", 1]
    assert first.model == "ARIMA(1,1,1)" and abs(first.phi - 0.6) < 0.08 and abs(first.theta - 0.4) < 0.12
    assert abs(first.yhat - (y[-1] + 0.2 + 0.6 * d[-1] + 0.4 * shock[-1])) < 0.6
    # later steps follow the change by its coefficient, towards a mean change of 0.5
    steps = [out["moving", h].yhat for h in (1, 2, 3)]
    assert abs((steps[2] - steps[1]) - (0.2 + 0.6 * (steps[1] - steps[0]))) < 0.1
    assert out["short", 1].model == "ARIMA(1,0,0)" and out["short", 1].theta is None
