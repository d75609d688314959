"""Price strategies over product contexts.

A strategy is a set of column expressions over one context row: no joins and no
shuffle. Prices come from the closed optimum where there is one, else from a coarse grid that
is narrowed around its best point, evaluated inside the row.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.functions.expr import let, places
from shelfspark.session import ship

# Margins and bounds, category elasticities, price steps, strategy weights,
# confidences and segment multipliers.
MIN_MARGIN, MAX_DISCOUNT, MAX_MARKUP = 0.10, 0.40, 0.50
CATEGORY_ELASTICITY = {"luxury": -0.8, "necessity": -0.5, "general": -1.5, "discretionary": -2.0, "commodity": -2.5}
ACTIONS = [-0.15, -0.10, -0.05, 0.0, 0.05, 0.10, 0.15]
WEIGHTS = {
    "rule_based": 0.15, "elasticity": 0.12, "optimization": 0.18, "reinforcement_learning": 0.10,
    "multi_armed_bandit": 0.08, "deep_learning": 0.15, "multi_objective": 0.12, "customer_segmentation": 0.10,
}
CONFIDENCE = {
    "rule_based": 0.7, "elasticity": 0.78, "optimization": 0.82, "reinforcement_learning": 0.65,
    "multi_armed_bandit": 0.6, "deep_learning": 0.75, "multi_objective": 0.8, "customer_segmentation": 0.72,
    "ensemble": 0.9,
}
SEGMENTS = {"premium": 1.2, "standard": 1.0, "price_sensitive": 0.8}
COARSE, FINE, ROUNDS = 16, 4, 4  # intervals of the first grid, of a step of a later one, later grids
ARMS = 10

C = F.col


def product_context(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Contexts from any product table: `columns` maps context fields to source columns.

    Text that is not a number and missing columns take the defaults.
    """

    def num(name: str, default: Column) -> Column:
        if columns.get(name) not in df.columns:
            return default
        v = F.col(columns[name]).cast("string").try_cast("double")
        return F.coalesce(F.when(~F.isnan(v), v), default)

    price = num("current_price", F.lit(10.0))
    out = df.withColumn("__p", price)
    none = F.lit(None)
    category = F.col(columns["category"]) if columns.get("category") in df.columns else F.lit("general")
    return out.select(
        F.col(columns["product_id"]).cast("string").alias("product_id"),
        C("__p").alias("current_price"),
        num("base_cost", C("__p") * 0.65).alias("base_cost"),
        num("current_stock", F.lit(100.0)).cast("bigint").alias("current_stock"),
        num("demand_forecast", F.lit(50.0)).alias("demand_forecast"),
        num("competitor_price", C("__p") * 0.95).alias("competitor_price"),
        F.coalesce(category.cast("string"), F.lit("general")).alias("category"),
        num("seasonality_index", F.lit(1.0)).alias("seasonality_index"),
        num("market_share", F.lit(0.0)).alias("market_share"),
        num("price_sensitivity_score", F.lit(1.0)).alias("price_sensitivity_score"),
        num("brand_loyalty_score", F.lit(0.5)).alias("brand_loyalty_score"),
        num("days_until_expiry", none.cast("double")).cast("int").alias("days_until_expiry"),
        (num("is_promotion", F.lit(0.0)) > 0).alias("is_promotion"),
        (C(columns["cross_sell_products"]) if columns.get("cross_sell_products") in df.columns
         else F.array().cast(T.ArrayType(T.StringType()))).alias("cross_sell_products"),
        (C(columns["customer_segments"]) if columns.get("customer_segments") in df.columns
         else none.cast(T.MapType(T.StringType(), T.DoubleType()))).alias("customer_segments"),
        num("day_of_week", F.lit(0.0)).cast("int").alias("day_of_week"),
        (num("is_weekend", F.lit(0.0)) > 0).alias("is_weekend"),
        (num("is_holiday", F.lit(0.0)) > 0).alias("is_holiday"),
        num("hour_of_day", F.lit(12.0)).cast("int").alias("hour_of_day"),
        num("elasticity_estimate", none.cast("double")).alias("elasticity_estimate"),
    )


def _floor_price() -> Column:
    return C("base_cost") * (1 + MIN_MARGIN)


def _top_price() -> Column:
    return C("current_price") * (1 + MAX_MARKUP)


def _clip(p: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(p, lo), hi)


def elasticity_prior() -> Column:
    """Category elasticity scaled by sensitivity, blended with an estimate, shifted by promotion and loyalty."""
    base = F.lit(-1.5)
    for name, e in CATEGORY_ELASTICITY.items():
        base = F.when(C("category") == name, e).otherwise(base)
    base = base * C("price_sensitivity_score")
    if_known = 0.7 * base + 0.3 * C("elasticity_estimate")
    base = F.when(C("elasticity_estimate").isNotNull(), if_known).otherwise(base)
    base = base * F.when(C("is_promotion"), 1.3).otherwise(1.0)
    return base * F.when(C("brand_loyalty_score") > 0.7, 0.8).otherwise(1.0)


def strategy_elasticity_prior(ctx: DataFrame) -> DataFrame:
    return ctx.withColumn("elasticity", elasticity_prior())


def best_of(score: Callable[[Column], Column], prices: list[Column]) -> Column:
    """The price with the highest score, the first one on ties."""
    return best_on(score, len(prices), lambda i: F.get(F.array(*prices), i))


def best_on(score: Callable[[Column], Column], n: int, price: Callable[[Column], Column]) -> Column:
    """The best of the prices 0 to n - 1, the first one on ties."""

    def point(i):
        p = price(i)
        return F.struct(score(p).alias("s"), (-i).alias("k"), p.alias("p"))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point))["p"]


def narrowed(df: DataFrame, score: Callable[[Column], Column], name: str, kinks: list[Column]) -> DataFrame:
    """`df` with the best price between floor and top price as `name`.

    The best of COARSE + 1 even prices is the centre of a grid of a FINE-th of its step, and so on; the
    vertex of the parabola through the last centre and its neighbours is the price, unless a price of `kinks`, where the
    score may bend, scores higher. Prices have four places. About 50 scores per row.
    """
    lo, hi = _floor_price(), _top_price()
    width = hi - lo
    df = df.withColumn(name, best_on(score, COARSE + 1, lambda i: lo + width * (i / COARSE)))
    for r in range(1, ROUNDS + 1):
        step = width / (COARSE * FINE**r)
        df = df.withColumn(name, best_on(score, 2 * FINE - 1, lambda i, step=step: _clip(C(name) + step * (i + 1 - FINE), lo, hi)))
    step = width / (COARSE * FINE**ROUNDS)
    df = df.withColumn("__y", F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: score(C(name) + step * k)))
    left, mid, right = (C("__y")[k] for k in range(3))
    bend = left - 2 * mid + right
    inside = (mid >= left) & (mid >= right) & (bend < 0) & (C(name) - step >= lo) & (C(name) + step <= hi)
    df = df.withColumn(name, F.when(inside, C(name) - step / 2 * ((right - left) / bend)).otherwise(C(name)))
    kinks = [F.when((k > lo) & (k < hi), k).otherwise(C(name)) for k in kinks]
    return df.withColumn(name, places(best_of(score, [C(name), *kinks]), 4)).drop("__y")


def _at(p: Column) -> Column:
    """Demand at price p by the context's elasticity."""
    return C("demand_forecast") * F.pow(p / C("current_price"), C("elasticity"))


def _risk(change: Column, medium: float, high: float) -> Column:
    return F.when(F.abs(change) > high, "High").when(F.abs(change) > medium, "Medium").otherwise("Low")


def _result(df: DataFrame, name: str, price: Column, demand: Callable[[Column], Column], reasoning: Column,
            drivers: Column, risk: tuple[float, float] | None = None) -> DataFrame:
    """The recommendation columns of one strategy next to the context; money follows from price and demand at six places."""
    out = df.withColumn("recommended_price", places(price, 6))
    p = C("recommended_price")
    out = out.withColumn("expected_demand", places(demand(p), 6))
    d = C("expected_demand")
    change = (p - C("current_price")) / C("current_price")
    return out.withColumns(
        {
            "expected_revenue": p * d,
            "expected_profit": (p - C("base_cost")) * d,
            "expected_market_share": F.least(F.lit(1.0), d / (C("demand_forecast") * 1.5)),
            "confidence_score": F.lit(CONFIDENCE[name]),
            "strategy_used": F.lit(name),
            "reasoning": reasoning,
            "feature_importance": drivers,
            "risk_assessment": _risk(change, *risk) if risk else F.lit("Medium"),
        }
    )


def _map(**items: Column) -> Column:
    return F.create_map(*[x for k, v in items.items() for x in (F.lit(k), v.cast("double"))])


def _rule_parts() -> dict[str, Column]:
    speed = C("demand_forecast") / F.greatest(C("current_stock").cast("double"), F.lit(1.0))
    velocity = F.when(speed < 0.3, -F.least(F.lit(0.25), (0.3 - speed) * 0.5)).when(
        speed > 0.8, F.least(F.lit(0.20), (speed - 0.8) * 0.3)
    ).otherwise(0.0)
    time = (
        F.when(C("is_weekend"), 1.05).otherwise(1.0) * F.when(C("is_holiday"), 1.10).otherwise(1.0)
        * F.when(C("hour_of_day").between(18, 21), 1.03).otherwise(1.0)
    )
    gap = F.when(C("competitor_price") > 0, (C("current_price") - C("competitor_price")) / C("competitor_price"))
    compete = F.when((gap > 0.10) & (C("market_share") < 0.3), 0.98).when((gap < -0.05) & (C("market_share") > 0.4), 1.05)
    loyalty = F.when(C("brand_loyalty_score") > 0.7, 0.05 * C("brand_loyalty_score")).otherwise(0.0)
    days = C("days_until_expiry")
    expiry = F.when(days <= 1, 0.40).when(days <= 2, 0.25).when(days <= 4, 0.15).otherwise(0.0)
    cross = F.least(F.lit(0.10), F.coalesce(F.size("cross_sell_products"), F.lit(0)) * 0.03)
    return {"velocity": velocity, "time": time, "gap": gap, "compete": compete, "loyalty": loyalty, "expiry": expiry,
            "cross": F.greatest(cross, F.lit(0.0))}


def rule_price() -> Column:
    """Velocity, time and season factors, competitor match, then loyalty, expiry and bundle, within bounds."""
    r = _rule_parts()
    p = C("current_price") * (1 + r["velocity"]) * r["time"] * C("seasonality_index")
    p = F.when(r["compete"].isNotNull(), C("competitor_price") * r["compete"]).otherwise(p)
    p = p * (1 + r["loyalty"]) * (1 - r["expiry"]) * (1 - r["cross"])
    return _clip(p, F.greatest(_floor_price(), C("current_price") * (1 - MAX_DISCOUNT)), _top_price())


def strategy_rule_based(ctx: DataFrame) -> DataFrame:
    r = _rule_parts()
    said = [
        F.when(r["velocity"] < 0, "Slow velocity").when(r["velocity"] > 0, "High velocity"),
        F.when(C("is_weekend"), "Weekend +5%"),
        F.when(C("is_holiday"), "Holiday +10%"),
        F.when(C("hour_of_day").between(18, 21), "Peak hours +3%"),
        F.when(C("seasonality_index") != 1.0, "Seasonality"),
        F.when(r["compete"] < 1, "Competitor match").when(r["compete"] > 1, "Market leader premium +5%"),
        F.when(r["loyalty"] > 0, "Loyalty premium"),
        F.when(r["expiry"] > 0, "Expiry urgency"),
        F.when(r["cross"] > 0, "Cross-sell discount"),
    ]
    text = F.array_join(F.array_compact(F.array(*said)), " | ")
    drivers = _map(
        stock_velocity=r["velocity"] * 100, time=(r["time"] - 1) * 100, seasonality=(C("seasonality_index") - 1) * 100,
        competition=F.when(r["compete"] < 1, -r["gap"] * 100).when(r["compete"] > 1, 5.0).otherwise(0.0),
        brand_loyalty=r["loyalty"] * 100, perishability=-r["expiry"] * 100, cross_sell=-r["cross"] * 100,
    )

    def demand(p):
        change = (p - C("current_price")) / C("current_price")
        return C("demand_forecast") * F.greatest(F.lit(0.0), 1 - change * 0.5)

    said_text = F.when(text == "", "No adjustments").otherwise(text)
    return _result(ctx, "rule_based", rule_price(), demand, said_text, drivers, (0.1, 0.2))


def elasticity_price() -> Column:
    """Where profit at constant elasticity e is highest: cost * e / (1 + e) for elastic demand, else the top price."""
    e = C("elasticity")
    best = F.when(e < -1, C("base_cost") * e / (1 + e)).otherwise(_top_price())
    return _clip(best, _floor_price(), _top_price())


def strategy_elasticity(ctx: DataFrame) -> DataFrame:
    df = strategy_elasticity_prior(ctx)
    return _result(df, "elasticity", elasticity_price(), _at, F.lit("Elasticity"),
                   _map(elasticity=F.abs("elasticity") * 100), (0.1, 0.2))


def optimization_score(p: Column) -> Column:
    """Weighted profit, revenue and share at a price, less penalties for demand over the stock and for a price under the floor."""
    near = F.exp(-2 * F.abs(p - C("competitor_price")) / C("competitor_price"))
    final = _at(p) * C("seasonality_index")
    final = F.when(C("competitor_price") > 0, final * (0.7 + 0.3 * near)).otherwise(final)

    def gain(f: Column) -> Column:
        over = F.greatest(f - C("current_stock"), F.lit(0.0))
        under = F.greatest(_floor_price() - p, F.lit(0.0))
        share = f / (C("demand_forecast") * 1.5 + 1e-6)
        return 0.6 * ((p - C("base_cost")) * f) + 0.3 * (p * f) + 0.1 * share * 1000 - (over * over * 10 + under * under * 100)

    return let(final, gain)


def optimization_price(df: DataFrame, name: str) -> DataFrame:
    return narrowed(df, optimization_score, name, [C("competitor_price")])


def strategy_optimization(ctx: DataFrame) -> DataFrame:
    df = optimization_price(strategy_elasticity_prior(ctx), "__best")
    return _result(df, "optimization", C("__best"), lambda p: _at(p) * C("seasonality_index"),
                   F.lit("Profit, revenue and share"), _map(optimization_score=F.lit(90))).drop("__best")


def multi_objective_price() -> Column:
    """The best of floor, top and the price where the slope of the weighted objectives is 0.

    The objectives are d * (0.8 p - b) with b = 0.5 cost - 2000 / (1.2 forecast + 1e-6), so the slope is 0 at
    e b / (0.8 (1 + e)).
    """
    e, lo, hi = C("elasticity"), _floor_price(), _top_price()
    b = 0.5 * C("base_cost") - F.lit(2000.0) / (C("demand_forecast") * 1.2 + 1e-6)
    flat = F.when(e != -1, e * b / (0.8 * (1 + e))).otherwise(lo)
    return best_of(lambda p: _at(p) * (0.8 * p - b), [lo, hi, _clip(flat, lo, hi)])


def strategy_multi_objective(ctx: DataFrame) -> DataFrame:
    df = strategy_elasticity_prior(ctx)
    drivers = _map(profit_weight=F.lit(50), revenue_weight=F.lit(30), share_weight=F.lit(20))
    return _result(df, "multi_objective", multi_objective_price(), _at, F.lit("Weighted objectives"), drivers)


def segments_price() -> Column:
    default = F.create_map(*[x for k, v in SEGMENTS.items() for x in (F.lit(k), F.lit(v))])
    given = C("customer_segments")
    multipliers = F.map_values(F.when(given.isNotNull() & (F.size(given) > 0), given).otherwise(default))
    total = F.aggregate(multipliers, F.lit(0.0), lambda a, m: a + C("current_price") * m)
    return total / F.size(multipliers)


def strategy_segments(ctx: DataFrame) -> DataFrame:
    df = strategy_elasticity_prior(ctx)
    return _result(df, "customer_segmentation", segments_price(), _at, F.lit("Mean of the segment prices"),
                   _map(segments=F.lit(100)))


def state_of() -> Column:
    stock, demand = C("current_stock").cast("double"), C("demand_forecast")
    level = F.when(stock > demand * 2, "high").when(stock > demand, "medium").otherwise("low")
    pull = F.when(demand > stock * 0.7, "high").when(demand > stock * 0.3, "medium").otherwise("low")
    price, other = C("current_price"), C("competitor_price")
    place = F.when(price > other, "above").when(F.abs(price - other) < 0.5, "at").otherwise("below")
    return F.concat_ws("_", level, pull, place)


def strategy_state_action(ctx: DataFrame, qtable: DataFrame, eps: float = 0.1, seed: int = 42) -> DataFrame:
    """Best learned price step of the context's state; unlearned steps count as 0, the first wins ties.

    `qtable` holds (state, step 0..6, value). There are at most 27 states, so the
    pivoted table is a fixed-size broadcast.
    """
    steps = range(len(ACTIONS))
    known = qtable.groupBy("state").agg(
        F.array(*[F.coalesce(F.max(F.when(C("step") == i, C("value"))), F.lit(0.0)) for i in steps]).alias("__q")
    )
    df = strategy_elasticity_prior(ctx).withColumn("state", state_of()).join(F.broadcast(known), "state", "left")
    q = F.coalesce("__q", F.array(*[F.lit(0.0)] * len(ACTIONS)))
    greedy = F.array_position(q, F.array_max(q)) - 1
    dice = F.pmod(F.xxhash64("product_id", F.lit(seed)), F.lit(10_000)) / 10_000
    anyone = F.pmod(F.xxhash64("product_id", F.lit(seed + 1)), F.lit(len(ACTIONS)))
    df = df.withColumn("step", F.when(dice < eps, anyone).otherwise(greedy).cast("int"))
    df = df.withColumn("action", F.get(F.array(*[F.lit(a) for a in ACTIONS]), C("step")))
    value = F.get(q, C("step"))
    price = _clip(C("current_price") * (1 + C("action")), _floor_price(), _top_price())
    return _result(df, "reinforcement_learning", price, _at, F.concat(F.lit("State "), C("state")),
                   _map(q_value=F.abs(value) * 10))


def strategy_bandit(ctx: DataFrame, arms: DataFrame, seed: int = 42, draw: bool = False) -> DataFrame:
    """One of ten price arms by its Beta posterior: by a seeded draw, or by the posterior mean, the first on ties.

    `arms` holds (product_id, prices, wins, losses) as `arm_results` makes them. Arms outside the context's floor and top price
    are not drawn; a context of which no arm is inside keeps its price, within the bounds. A context without a row has
    the flat prior on even steps from floor to top.
    """
    known = arms.select("product_id", *[C(c).alias(f"__{c}") for c in ("prices", "wins", "losses")])
    zeros, lo, hi = F.array(*[F.lit(0.0)] * ARMS), _floor_price(), _top_price()
    even = F.array(*[lo + (hi - lo) * (i / (ARMS - 1)) for i in range(ARMS)])
    df = strategy_elasticity_prior(ctx).join(known, "product_id", "left").withColumns(
        {"__prices": F.coalesce("__prices", even), "__wins": F.coalesce("__wins", zeros), "__losses": F.coalesce("__losses", zeros)}
    )
    if draw:
        df = df.withColumn("__s", beta_draws(df.sparkSession, seed)("product_id", "__wins", "__losses"))
    else:
        df = df.withColumn("__s", F.zip_with("__wins", "__losses", lambda w, lo: (w + 1) / (w + lo + 2)))
    inside = F.zip_with("__s", "__prices", lambda s, p: F.when((p >= lo) & (p <= hi), s).otherwise(F.lit(-1.0)))
    df = df.withColumn("__s", inside).withColumn("arm", F.when(F.array_max("__s") >= 0, F.array_position("__s", F.array_max("__s")) - 1).cast("int"))
    price = _clip(F.coalesce(F.get("__prices", C("arm")), C("current_price")), lo, hi)
    return _result(df, "multi_armed_bandit", price, _at, F.lit("Best price arm"),
                   _map(bandit_confidence=F.greatest(F.array_max("__s"), F.lit(0.0)) * 100)).drop("__prices", "__wins", "__losses", "__s")


def beta_draws(spark, seed: int):
    """Vectorised Beta draws; each row's generator is keyed by its id, so a rerun repeats them."""
    ship(spark)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def draws(ids: pd.Series, wins: pd.Series, losses: pd.Series) -> pd.Series:
        out = []
        for key, w, l in zip(ids, wins, losses):
            rng = np.random.default_rng([seed, zlib.crc32(key.encode())])
            out.append(rng.beta(np.asarray(w) + 1, np.asarray(l) + 1).tolist())
        return pd.Series(out)

    return draws


def strategy_ensemble(
    ctx: DataFrame, members: dict[str, Column | Callable[[DataFrame], DataFrame]], weights: dict[str, float] | None = None
) -> DataFrame:
    """Confidence-weighted mean price of the member strategies.

    A member is a price expression, or a function that adds `recommended_price` where it
    needs learned tables. All of them work on the same context rows, so the blend is a row
    expression: no union, no second read of the contexts, no grouping.
    """
    weights = weights or WEIGHTS
    df = strategy_elasticity_prior(ctx)
    df = df.withColumns({f"__p_{n}": places(m, 6) for n, m in members.items() if isinstance(m, Column)})
    for name, member in members.items():
        if not isinstance(member, Column):
            df = member(df).select(*df.columns, places("recommended_price", 6).alias(f"__p_{name}"))
    w = {name: weights[name] * CONFIDENCE[name] for name in members}
    votes = [C(f"__p_{n}") * x for n, x in w.items()]
    price = sum(votes[1:], votes[0]) / (sum(w.values()) + 1e-9)
    out = _result(df, "ensemble", price, lambda p: F.greatest(F.lit(0.0), _at(p)), F.lit("Weighted strategies"),
                  _map(ensemble_diversity=F.lit(95)), (0.12, 0.25))
    prices = [C(f"__p_{n}") for n in members]
    return out.withColumns({"low_price": F.least(*prices), "high_price": F.greatest(*prices)}).drop(*[f"__p_{n}" for n in members])


def batch_pricing(recs: DataFrame) -> DataFrame:
    """One report row per recommendation with its change and three strongest drivers."""
    ranked = F.array_sort(
        F.transform(F.map_entries("feature_importance"), lambda e: F.struct((-F.abs(e["value"])).alias("k"), e["key"].alias("n")))
    )
    return recs.select(
        "product_id", "current_price", "recommended_price",
        ((C("recommended_price") - C("current_price")) / C("current_price") * 100).alias("change_pct"),
        "expected_demand", "expected_revenue", "expected_profit", "expected_market_share", "confidence_score",
        "risk_assessment", "strategy_used",
        F.array_join(F.transform(F.slice(ranked, 1, 3), lambda e: e["n"]), ", ").alias("top_features"),
    )


def pricing_report(recs: DataFrame, top: int = 10) -> DataFrame:
    """Lift, confidence and risk figures over all recommendations, and the largest profit gains."""
    now_profit = (C("current_price") - C("base_cost")) * C("demand_forecast")
    gains = recs.select("product_id", (C("expected_profit") - now_profit).alias("gain"))
    best = gains.orderBy(C("gain").desc(), "product_id").limit(top)
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-C("gain")).alias("k"), C("product_id").alias("n")))).alias("l"))
    out = recs.agg(
        F.count(F.lit(1)).alias("products"),
        (F.avg((C("recommended_price") - C("current_price")) / C("current_price")) * 100).alias("avg_price_change"),
        F.sum(C("current_price") * C("demand_forecast")).alias("__r0"), F.sum("expected_revenue").alias("__r1"),
        F.sum(now_profit).alias("__p0"), F.sum("expected_profit").alias("__p1"),
        (F.avg("confidence_score") * 100).alias("avg_confidence"),
        *[F.count_if(C("risk_assessment") == r).alias(f"risk_{r.lower()}") for r in ("Low", "Medium", "High")],
    )

    def lift(a, b):
        return F.when(C(a) != 0, (C(b) - C(a)) / F.greatest(F.lit(1.0), C(a)) * 100).otherwise(0.0)

    out = out.withColumns({"revenue_lift": lift("__r0", "__r1"), "profit_lift": lift("__p0", "__p1")})
    out = out.withColumn("__l", listed.scalar())
    return out.withColumn("top_opportunities", F.array_join(C("__l")["n"], ", ")).drop("__r0", "__r1", "__p0", "__p1", "__l")


def learned_steps(history: DataFrame) -> DataFrame:
    """Mean reward (revenue / 1000) of each price step in each state, from past context rows.

    `history` has the context columns plus price_change and revenue.
    """
    step = F.round(C("price_change") / 0.05) + 3
    rows = history.filter(C("price_change").isNotNull()).select(
        state_of().alias("state"),
        F.greatest(F.lit(0.0), F.least(F.lit(6.0), step)).cast("int").alias("step"),
        (C("revenue") / 1000.0).alias("reward"),
    )
    return rows.groupBy("state", "step").agg(F.avg("reward").alias("value"))


def arm_results(history: DataFrame, key: str, time: str) -> DataFrame:
    """(key, time, prices, wins, losses): price arms of a product, and what each had won and lost in the weeks before.

    `history` has (key, time, sold_price, sold_revenue, expected_revenue), a row per product and week. The arms are the tenths of a
    product's prices, each at its lowest one; a product of fewer than ten weeks has arms without a price. A sale wins above 80 % of the
    revenue expected of it, a week without an expectation counts for neither. Windows over the product's calendar: no week meets another.
    """
    every = Window.partitionBy(key)
    before = every.orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    df = history.withColumns(
        {"arm": F.ntile(ARMS).over(every.orderBy("sold_price", time)) - 1, "won": C("sold_revenue") > C("expected_revenue") * 0.8}
    )
    lowest = F.array(*[F.min(F.when(C("arm") == i, C("sold_price"))).over(every) for i in range(ARMS)])

    def per_arm(hit: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(hit & (C("arm") == i), 1.0)).over(before), F.lit(0.0)) for i in range(ARMS)])

    return df.select(key, time, lowest.alias("prices"), per_arm(C("won")).alias("wins"), per_arm(~C("won")).alias("losses"))
