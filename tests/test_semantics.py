"""Operators against hand-made frames and brute force."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfspark.operators import anomaly as N
from shelfspark.operators import cleaning as C
from shelfspark.operators import filters as P
from shelfspark.operators import forecast as O
from shelfspark.operators import inventory as I
from shelfspark.operators import models as M
from shelfspark.operators import pricing as E
from shelfspark.operators import strategies as S
from shelfspark.operators import windows as W
from shelfspark.plans import pricing as PP

MON = datetime.date(2024, 1, 1)


def series(spark, values, name="A", step=7, date="week_start"):
    rows = [(name, MON + datetime.timedelta(days=step * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"product_name string, {date} date, sales_qty double")


def column(df, c, order="week_start"):
    return [r[c] for r in df.orderBy(order).collect()]


def test_interpolation_limit_matches_pandas(spark):
    v = [None, 1.0] + [None] * 12 + [15.0, None, None]
    got = column(C.interpolate_linear(series(spark, v)), "sales_qty")
    idx = pd.to_datetime([MON + datetime.timedelta(days=7 * i) for i in range(len(v))])
    want = pd.Series(v, index=idx, dtype=float).interpolate(method="time", limit=8)
    assert [None if pd.isna(x) else pytest.approx(x) for x in want] == got


def test_interpolation_both_directions(spark):
    got = column(C.interpolate_linear(series(spark, [None, 2.0, None, 4.0, None]), limit=None, both=True), "sales_qty")
    assert got == [2.0, 2.0, 3.0, 4.0, 4.0]


def test_zero_policy_sides(spark):
    dense = series(spark, [0.0, 5.0, -1.0, 6.0, 7.0], "A", 1, "date")
    sparse = series(spark, [0.0, 0.0, 9.0, 0.0], "B", 1, "date")
    out = C.zero_policy(dense.unionByName(sparse))
    assert column(out.filter("product_name = 'A'"), "sales_qty", "date") == [None, 5.0, None, 6.0, 7.0]
    assert column(out.filter("product_name = 'B'"), "sales_qty", "date") == [9.0, 9.0, 9.0, 9.0]


def test_short_products_go_to_the_rejects(spark):
    df = series(spark, [1.0] * 70, "long", 1, "date").unionByName(series(spark, [1.0] * 10, "short", 1, "date"))
    assert {r.product_name for r in C.preprocess_weekly(df, ["sales_qty"]).collect()} == {"long"}
    assert [(r.product_name, r.weeks) for r in C.weekly_rejects(df, ["sales_qty"]).collect()] == [("short", 2)]


def test_dedupe_takes_last_by_tie(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b")], "k string, t int, v string")
    assert C.dedupe_keep_last(df, ["k"], ["t"]).first().v == "c"


def test_code_filter_keeps_all_when_all_are_codes(spark):
    df = spark.createDataFrame([("P1",), ("AB12",)], "label string")
    assert P.filter_code_regex(df, "label").count() == 2
    mixed = spark.createDataFrame([("P1",), ("Milk",)], "label string")
    assert [r.label for r in P.filter_code_regex(mixed, "label").collect()] == ["Milk"]


def test_strict_and_partial_windows(spark):
    df = series(spark, [1.0, 2.0, 3.0, 6.0])
    assert column(df.withColumn("m", W.full(F.avg, "sales_qty", 3)), "m") == [None, None, 2.0, pytest.approx(11 / 3)]
    assert column(W.rolling_partial(df, (2,)), "rolling_std_2")[0] == 0.0


def test_half_trend_needs_four_rows(spark):
    assert W.half_trend(series(spark, [1.0, 2.0, 3.0])).first().half_trend == 0.0
    assert W.half_trend(series(spark, [1.0, 1.0, 2.0, 2.0])).first().half_trend == pytest.approx(1.0, rel=1e-5)


def brute_decompose(y, p, mult):
    n, h = len(y), p // 2
    trend = np.full(n, np.nan)
    for i in range(h, n - h):
        w = y[i - h : i + h + 1].astype(float).copy()
        if p % 2 == 0:
            w[0] *= 0.5
            w[-1] *= 0.5
        trend[i] = w.sum() / p
    d = y / trend if mult else y - trend
    m = np.array([np.nanmean(d[s::p]) for s in range(p)])
    m = m / m.mean() if mult else m - m.mean()
    s = np.array([m[i % p] for i in range(n)])
    return trend, s, (y / s / trend if mult else y - s - trend)


@pytest.mark.parametrize("n", [60, 71, 130])
@pytest.mark.parametrize("mult", [True, False])
def test_decomposition_with_short_periods(spark, n, mult):
    rng = np.random.default_rng(n)
    y = 100 + 10 * np.sin(np.arange(n) / 5) + rng.normal(0, 3, n)
    df = series(spark, [float(v) for v in y])
    got = O.decompose_classical(df, 52, "multiplicative" if mult else "additive").orderBy("date").collect()
    trend, seasonal, resid = brute_decompose(y, min(52, n // 2), mult)
    assert len(got) == n
    for r, t, s, e in zip(got, trend, seasonal, resid):
        assert r.seasonal == pytest.approx(s, rel=1e-9, abs=1e-9)
        assert (r.trend is None) == bool(np.isnan(t))
        if r.trend is not None:
            assert r.trend == pytest.approx(t, rel=1e-9)
            assert r.resid == pytest.approx(e, rel=1e-9, abs=1e-7)


@pytest.mark.parametrize("n", [2, 5, 10, 40])
def test_moving_average_width_follows_length(spark, n):
    y = [float(i * i % 17) for i in range(n)]
    out = O.forecast_moving_average(series(spark, y, "A", 1, "date"), 3)
    k = max(1, min(7, n // 3))
    fitted = column(out.filter("kind = 'fitted'"), "yhat", "date")
    assert fitted == [pytest.approx(np.mean(y[max(0, i - k + 1) : i + 1])) for i in range(n)]
    assert column(out.filter("kind = 'forecast'"), "yhat", "date") == [pytest.approx(np.mean(y[-k:]))] * 3


def test_centred_expectation_of_short_products(spark):
    y = [float(v) for v in [5, 6, 7, 5, 6, 7, 5, 6, 7, 50, 6, 7]]
    got = column(N.scored(series(spark, y).withColumn("category", F.lit("c"))), "expected_sales")
    k = min(8, len(y) // 2)
    want = pd.Series(y).rolling(k, center=True).mean().ffill().bfill()
    assert got == [pytest.approx(v) for v in want]


def test_four_week_windows_cannot_flag(spark):
    y = [1.0] * 20 + [1000.0] + [1.0] * 5
    df = series(spark, y).withColumn("category", F.lit("c"))
    assert N.anomaly_rolling_2sigma(df).count() == 0
    assert N.anomaly_rolling_2sigma(df, 12).count() == 1


def test_elasticity_recovers_a_power_law(spark):
    rng = np.random.default_rng(1)
    p = rng.uniform(8, 12, 60)
    rows = [("A", MON + datetime.timedelta(days=7 * i), float(x), float(1000 * x**-1.7)) for i, x in enumerate(p)]
    df = spark.createDataFrame(rows, "product_name string, week_start date, price double, sales_qty double")
    assert E.elasticity_gated(df).first().elasticity == pytest.approx(-1.7, abs=1e-4)
    assert E.elasticity_simple(df).first().elasticity == pytest.approx(-1.7, abs=1e-4)
    assert E.elasticity_simple(df.limit(5)).first().elasticity == -1.2
    assert E.elasticity_ridge(df.limit(5)).first().classification == "Insufficient Data"
    r = E.elasticity_ridge(df).first()
    x, y = np.log(p + 1e-6), np.log(1000 * p**-1.7 + 1e-6)
    xc, yc = x - x.mean(), y - y.mean()
    assert r.method == "log-log" and r.elasticity == pytest.approx((xc @ yc) / (xc @ xc + 0.1))


def test_trajectory_restock_and_stockout(spark):
    k = spark.createDataFrame([("A", 10.0, 21.0, 0.0, 5.0, 30.0)], "product_name string, current_stock double, weekly_demand double, growth double, lead double, reorder double")
    r = I.stock_trajectory(k).first()
    assert r.trajectory[:7] == [7.0, 4.0, 1.0, 0.0, 0.0, 0.0, 27.0] and r.stockout_day == 3
    assert len(r.trajectory) == 30


def test_weights_fall_back_to_the_base(spark):
    rows = [("A", "prophet", 10.0), ("A", "xgb", 5.0), ("A", "lgbm", None), ("B", "prophet", None), ("B", "xgb", None), ("B", "lgbm", 0.0)]
    got = {(r.product_name, r.model): r.weight for r in O.ensemble_weights(spark.createDataFrame(rows, "product_name string, model string, rmse double")).collect()}
    assert sum(v for (p, _), v in got.items() if p == "A") == pytest.approx(1)
    assert got["A", "xgb"] > got["A", "lgbm"] > 0
    assert got["B", "lgbm"] == 1.0 and got["B", "prophet"] == 0.0


def test_folds_of_a_short_series(spark):
    rows = O.fold_rows(series(spark, [1.0] * 50)).groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in rows} == {(1, "train"): 18, (1, "test"): 16, (2, "train"): 34, (2, "test"): 16}


def test_harmonic_forecast_follows_a_season(spark, tables):
    out = O.forecast_trend_season(tables.panel, 10, "harmonic")
    assert out.filter("yhat_lower_95 > yhat_lower OR yhat_lower > yhat OR yhat > yhat_upper OR yhat_upper > yhat_upper_95").count() == 0
    t = np.arange(208)
    y = 50 + 20 * np.sin(2 * np.pi * t * 7 / 365.25)
    df = series(spark, [float(v) for v in y]).withColumns({"holiday_flag": F.lit(0), "promotion": F.lit(0)})
    got = O.forecast_trend_season(df, 26, "harmonic").orderBy("step").collect()
    want = 50 + 20 * np.sin(2 * np.pi * np.arange(208, 234) * 7 / 365.25)
    assert np.abs(np.array([r.yhat for r in got]) - want).mean() < 4


def test_searched_prices_are_the_best(spark, tables):
    """Against 100,001 even prices per context, over elastic and inelastic demand, with and without a bend at the competitor's price."""
    ctx = PP.contexts(tables).where("pmod(xxhash64(product_id), 200) = 0")
    some = ctx.withColumn("elasticity_estimate", F.lit(None).cast("double")).withColumn("category", F.lit("luxury"))
    ctx = ctx.union(some.withColumn("price_sensitivity_score", F.lit(0.4))).union(some.withColumn("price_sensitivity_score", F.lit(4.0)))
    x = np.linspace(0, 1, 100_001)
    for strategy, score in (
        (S.strategy_elasticity, lambda r, p, d: (p - r.base_cost) * d),
        (S.strategy_multi_objective, lambda r, p, d: 0.5 * (p - r.base_cost) * d + 0.3 * p * d + 0.2 * d / (r.demand_forecast * 1.2 + 1e-6) * 10000),
        (S.strategy_optimization, lambda r, p, d: opt_score(r, p, d)),
    ):
        found = strategy(ctx).collect()
        assert len(found) > 40
        for r in found:
            lo, hi = r.base_cost * 1.1, r.current_price * 1.5
            at = lambda p, r=r: score(r, p, r.demand_forecast * (p / r.current_price) ** r.elasticity)
            grid = at(lo + (hi - lo) * x)
            assert at(r.recommended_price) >= grid.max() - 1e-5 * abs(grid.max()), (strategy.__name__, r)  # prices have four places


def opt_score(r, p, d):
    f = d * r.seasonality_index * (0.7 + 0.3 * np.exp(-2 * np.abs(p - r.competitor_price) / r.competitor_price))
    over, under = np.maximum(f - r.current_stock, 0), np.maximum(r.base_cost * 1.1 - p, 0)
    return 0.6 * (p - r.base_cost) * f + 0.3 * p * f + 0.1 * f / (r.demand_forecast * 1.5 + 1e-6) * 1000 - (over**2 * 10 + under**2 * 100)


def test_bandit_learns_from_weeks_before(spark, tables):
    found = S.strategy_bandit(PP.contexts(tables), PP.arms(tables)).select("product_id", "arm", "recommended_price", "current_price").collect()
    assert len({r.arm for r in found}) == 11 and len({round(r.recommended_price / r.current_price, 4) for r in found}) > 500
    weeks = [(i, 10.0 + i, 100.0 if i % 2 else 10.0, 100.0) for i in range(10)] + [(10, 10.0, 5.0, None), (11, 10.5, 50.0, 100.0), (12, 30.0, 1.0, 1.0)]
    df = spark.createDataFrame([("A", *w) for w in weeks], "product string, week int, sold_price double, sold_revenue double, expected_revenue double")
    rows = {r.week: r for r in S.arm_results(df, "product", "week").collect()}
    assert rows[0].wins == rows[0].losses == [0.0] * 10 and rows[0].prices[:3] == [10.0, 10.5, 12.0] and rows[0].prices[-1] == 30.0
    # the first tenth holds 10.0 twice, the second 10.5 and 11.0; the week without an expectation counts for neither
    assert (rows[12].wins[:2], rows[12].losses[:2]) == ([0.0, 1.0], [1.0, 1.0])
    ctx = S.product_context(spark.createDataFrame([("A", "15"), ("B", "15")], "product string, price string"), {"product_id": "product", "current_price": "price"})
    picked = {r.product_id: r for r in S.strategy_bandit(ctx, S.arm_results(df, "product", "week").where("week = 12").withColumnRenamed("product", "product_id")).collect()}
    best = max((i for i in range(10) if 15 * 0.65 * 1.1 <= rows[12].prices[i] <= 22.5), key=lambda i: ((rows[12].wins[i] + 1) / (rows[12].wins[i] + rows[12].losses[i] + 2), -i))
    assert picked["A"].arm == best and picked["A"].recommended_price == rows[12].prices[best] and picked["B"].arm == 0


def test_bandit_draws_repeat(spark, tables):
    ctx, arms = PP.contexts(tables), PP.arms(tables)
    a, b = [sorted((r.product_id, r.arm) for r in S.strategy_bandit(ctx, arms, draw=True).collect()) for _ in range(2)]
    assert a == b and len({arm for _, arm in a}) >= 10


def test_exploration_share(spark, tables):
    ctx = PP.contexts(tables)
    q = S.learned_steps(PP.history(tables))
    greedy, explore = S.strategy_state_action(ctx, q, 0.0), S.strategy_state_action(ctx, q, 0.3)
    moved = greedy.select("product_id", "step").join(explore.select("product_id", F.col("step").alias("s2")), "product_id")
    share = moved.filter("step <> s2").count() / moved.count()
    assert 0.1 < share < 0.45


def test_isolation_finds_planted_points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (2000, 2))
    x[:20] += 12
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    out = M.anomaly_isolation(df, ["a", "b"], ["id"], share=0.02, trees=50)
    flagged = {r.id for r in out.filter("flag = -1").collect()}
    assert len(flagged) == pytest.approx(40, abs=2) and set(range(20)) <= flagged
    again = {r.id for r in M.anomaly_isolation(df, ["a", "b"], ["id"], share=0.02, trees=50).filter("flag = -1").collect()}
    assert again == flagged


def test_component_scores_match_numpy(spark, tables):
    cols = ["sales_qty", "price", "stock_on_hand"]
    df = tables.panel.select("product_name", "week_start", *cols)
    got = M.scale_pca(df, 2, ["product_name", "week_start"]).orderBy("product_name", "week_start").toPandas()
    x = df.orderBy("product_name", "week_start").toPandas()[cols].to_numpy(dtype=float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, _, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    want = z @ vt[:2].T
    for i in range(2):
        assert abs(np.corrcoef(got[f"pc{i + 1}"], want[:, i])[0, 1]) == pytest.approx(1, abs=1e-6)


def test_recursive_forecast_bounds_and_limits(spark, tables):
    out = M.forecast_recursive(tables.panel, 6, trees=2)
    assert out.count() == 6 * tables.panel.select("product_name").distinct().count()
    assert out.filter("yhat < 0 OR yhat_lower > yhat_upper").count() == 0
    with pytest.raises(ValueError):
        M.forecast_recursive(tables.panel, 157)


def test_demand_model_needs_rows(spark, tables):
    assert M.demand_model(tables.panel.limit(5)).count() == 0
