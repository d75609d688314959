"""Trained models: one pooled MLlib model over all products instead of one model per product."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY, TIME, by, clip_col, newest_first, ordered, stacked, with_scalars
from shelfspark.functions.stats import fill_median, quantile_row
from shelfspark.operators import strategies as S
from shelfspark.operators.filters import label_encode, project_numeric
from shelfspark.operators.forecast import (
    BASE_WEIGHTS, Z80, Z95, bounds, ensemble_blend, ensemble_weights, fold_rows, fold_summary, metrics, trend_fit, trend_value,
)
from shelfspark.operators.windows import cyclic, full, rolling_pair_smooth, split_chronological, weekly_features
from shelfspark.session import ship, written

TREES, DEPTH, SEED = 20, 5, 42


def assembled(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Feature vector of numeric columns, nulls as 0."""
    filled = df.withColumns({f"__{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    vec = VectorAssembler(inputCols=[f"__{c}" for c in cols], outputCol=out).transform(filled)
    return vec.drop(*[f"__{c}" for c in cols])


def fit_boosted(train: DataFrame, cols: list[str], label: str, trees: int = TREES):
    """Boosted trees on rows written once, so that no iteration repeats the feature windows."""
    rows = written(train.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(label).cast("double").alias("__y")), "train")
    return GBTRegressor(featuresCol="features", labelCol="__y", maxIter=trees, maxDepth=DEPTH, seed=SEED).fit(assembled(rows, cols))


def importances(model, cols: list[str], spark) -> DataFrame:
    """One row per feature: bounded by the number of columns."""
    return spark.createDataFrame([(c, float(v)) for c, v in zip(cols, model.featureImportances.toArray())], "feature string, importance double")


def _scored(model, df: DataFrame, cols: list[str], out: str = "prediction") -> DataFrame:
    return model.transform(assembled(df, cols)).drop("features").withColumnRenamed("prediction", out)


WEEKLY = (
    [f"lag_{k}" for k in (1, 2, 3, 7)]
    + [f"rolling_{s}_{k}" for k in (4, 8, 12, 26) for s in ("mean", "std")]
    + ["month", "quarter", "year", "weekofyear", "month_sin", "month_cos", "week_sin", "week_cos"]
)


def lagged_features(panel: DataFrame) -> DataFrame:
    """Weekly features of the history before each row, as the recursion sees them."""
    feats = weekly_features(panel.select(KEY, TIME, "sales_qty"))
    w = ordered()
    shifted = {c: F.lag(c).over(w) for c in WEEKLY if c.startswith("rolling")}
    return feats.withColumns(shifted).filter(F.col("rolling_mean_4").isNotNull())


def train_boosted(features: DataFrame, cols: list[str] | None = None, f: float = 0.8, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """Importances and hold-out scores of boosted trees trained on the first share of each product's weeks."""
    cols = cols or WEEKLY
    parts = written(split_chronological(features, f), "split")
    model = fit_boosted(parts.filter("split = 'train'"), cols, "sales_qty", trees)
    test = _scored(model, parts.filter("split = 'test'"), cols, "predicted")
    scores = metrics(test.withColumn("actual", F.col("sales_qty")).withColumn("model", F.lit("boosted")), ("model",))
    return importances(model, cols, features.sparkSession), scores


def train_validated(
    features: DataFrame, cols: list[str] | None = None, label: str = "sales_qty", fit: float = 0.7, valid: float = 0.85, trees: int = 80, depth: int = DEPTH, gain: float = 0.001,
) -> tuple[DataFrame, DataFrame]:
    """(importances, scores) of boosted trees that stop early and of a forest, on all numeric columns unless `cols` names some.

    Each product's weeks are split in order: models learn from the first `fit` share, boosting stops when the errors of the weeks up to
    `valid` no longer fall by the share `gain`, and scores are of the weeks after it. `size` is the number of trees kept, `trees` the most there can be.
    The mean of the four weeks before stands beside the learners.
    """
    cols = cols or [c for c in project_numeric(features.drop(KEY, TIME)).columns if c != label]
    share = F.row_number().over(ordered()) / F.count(F.lit(1)).over(by())
    part = F.when(share <= fit, "fit").when(share <= valid, "valid").otherwise("test")
    mean4 = F.avg(label).over(ordered().rowsBetween(-4, -1))
    rows = features.withColumns({"part": part, "__mean4": mean4}).where(F.col(label).isNotNull())
    rows = written(rows.select("part", "__mean4", *[F.col(c).cast("double").alias(c) for c in cols], F.col(label).cast("double").alias("__y")), "parts")
    known = assembled(rows.filter("part <> 'test'").withColumn("__held", F.col("part") == "valid"), cols)
    models = {
        "boosted": GBTRegressor(featuresCol="features", labelCol="__y", maxIter=trees, maxDepth=depth, seed=SEED, validationIndicatorCol="__held", validationTol=gain).fit(known),
        "forest": RandomForestRegressor(featuresCol="features", labelCol="__y", numTrees=trees, maxDepth=2 * depth, seed=SEED).fit(known.filter("NOT __held")),
    }
    test = rows.filter("part = 'test'")
    for name, model in models.items():
        test = _scored(model, test, cols, f"__{name}")
    long = stacked(test.withColumn("actual", F.col("__y")), "model", "predicted", [(m, F.col(f"__{m}")) for m in (*models, "mean4")], keep=["actual"])
    sizes = F.create_map(*[F.lit(v) for name, model in models.items() for v in (name, model.getNumTrees)])
    spark = features.sparkSession
    tables = [importances(model, cols, spark).withColumn("model", F.lit(name)) for name, model in models.items()]
    return tables[0].unionByName(tables[1]), metrics(long, ("model",)).withColumn("size", F.try_element_at(sizes, F.col("model")))


def demand_model(panel: DataFrame, test: float = 0.2, min_rows: int = 8) -> DataFrame:
    """R2, RMSE, MAE and importances of quantity on price, flags, stock, category and relative price.

    The split goes by a hash of the row's key, so it is the same on every run. No rows come
    back for fewer than `min_rows` rows.
    """
    avg = F.avg("price").over(by())
    rows = panel.withColumn("relative_price", F.try_divide(F.col("price"), avg))
    rows = label_encode(rows, ["category", "weather"])
    cols = ["price", "promotion", "holiday_flag", "stock_on_hand", "category_encoded", "weather_encoded", "relative_price"]
    rows = rows.withColumn("held", F.pmod(F.xxhash64(KEY, TIME), F.lit(1000)) < int(1000 * test))
    rows = written(rows.select(*cols, "sales_qty", "held"), "demand")
    spark = panel.sparkSession
    empty = spark.createDataFrame([], "kind string, name string, value double")
    if rows.count() < min_rows:
        return empty
    model = fit_boosted(rows.filter("NOT held"), cols, "sales_qty")
    scores = _scored(model, rows.filter("held"), cols, "predicted").withColumn("actual", F.col("sales_qty"))
    m = metrics(scores.withColumn("model", F.lit("demand")), ("model",))
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("r2", "rmse", "mae")])
    m = m.select(F.lit("metric").alias("kind"), F.explode(pairs).alias("p")).select("kind", "p.name", "p.value")
    return m.unionByName(importances(model, cols, spark).select(F.lit("importance").alias("kind"), F.col("feature").alias("name"), F.col("importance").alias("value")))


def next_week_demand(panel: DataFrame) -> DataFrame:
    """Predicted quantity of the next week per product from lags, 4-week mean, price and promotion."""
    w = ordered()
    rows = panel.withColumns(
        {"lag_1": F.lag("sales_qty", 1).over(w), "lag_2": F.lag("sales_qty", 2).over(w), "ma_4": full(F.avg, "sales_qty", 4),
         "n": F.count(F.lit(1)).over(by()), "age": F.row_number().over(newest_first())}
    ).filter("n >= 8")
    cols = ["lag_1", "lag_2", "ma_4", "price", "promotion"]
    rows = written(rows, "next-week")
    model = fit_boosted(rows.dropna(subset=[*cols, "sales_qty"]), cols, "sales_qty", 50)
    last = rows.filter("age = 1").withColumns(
        {"lag_2": F.col("lag_1"), "lag_1": F.col("sales_qty"), "promotion": F.lit(0)}
    )
    out = _scored(model, last, cols, "predicted_demand")
    return out.select(KEY, "stock_on_hand", F.greatest(F.lit(0.0), F.col("predicted_demand")).alias("predicted_demand"))


# ---- recursive forecast


def _window_of(hist: Column, k: int) -> Column:
    n = F.size(hist)
    return F.slice(hist, F.greatest(F.lit(1), n - k + 1), k)


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _std(a: Column) -> Column:
    m, n = _mean(a), F.size(a)
    return F.when(n > 1, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (n - 1))).otherwise(0.0)


def _step_features(df: DataFrame) -> DataFrame:
    """Features of the next week from the history array (newest last) and its date."""
    hist = F.col("hist")
    cols = {f"lag_{k}": F.coalesce(F.try_element_at(hist, F.lit(-k)), _mean(_window_of(hist, 4))) for k in (1, 2, 3, 7)}
    for k in (4, 8, 12, 26):
        cols[f"rolling_mean_{k}"] = _mean(_window_of(hist, k))
        cols[f"rolling_std_{k}"] = _std(_window_of(hist, k))
    cols |= {"month": F.month("date"), "quarter": F.quarter("date"), "year": F.year("date"), "weekofyear": F.weekofyear("date")}
    cols |= {**cyclic("month", F.month("date"), 12), **cyclic("week", F.weekofyear("date"), 52)}
    return df.withColumns(cols)


def _blend(feats: DataFrame, model, fit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weight of the seasonal line per product, and the deviation of the blend's residuals.

    The line is scored on all weeks, the boosted model on the held-out ones; a product
    without held-out weeks keeps the base weights.
    """
    rows = _scored(model, feats, WEEKLY, "boosted").join(fit, KEY)
    rows = written(rows.select(KEY, "split", F.col("sales_qty").alias("actual"), "boosted", trend_value(TIME, True).alias("line")), "scored")
    line = metrics(rows.select(KEY, "actual", F.col("line").alias("predicted"), F.lit("line").alias("model")))
    test = rows.filter("split = 'test'")
    trees = metrics(test.select(KEY, "actual", F.col("boosted").alias("predicted"), F.lit("boosted").alias("model")))
    base = {"line": BASE_WEIGHTS["prophet"], "boosted": BASE_WEIGHTS["xgb"] + BASE_WEIGHTS["lgbm"]}
    scores = line.select(KEY, "model", "rmse").unionByName(trees.select(KEY, "model", "rmse"))
    weights = ensemble_weights(scores, base).filter("model = 'line'").select(KEY, F.col("weight").alias("line_share"))
    blend = F.col("line_share") * F.col("line") + (1 - F.col("line_share")) * F.greatest(F.lit(0.0), F.col("boosted"))
    sd = rows.join(weights, KEY).groupBy(KEY).agg(F.stddev_pop(F.col("actual") - blend).alias("sd"))
    return weights, sd


def forecast_recursive(panel: DataFrame, horizon: int = 12, trees: int = TREES, keep: int = 26) -> DataFrame:
    """Week-by-week forecast of all products: each blended value joins the history of the next step.

    One pooled boosted model and the seasonal line are blended per product by
    `ensemble_weights`. The history a step needs is the last `keep` values in an array column, so a step is a
    projection and a model call for all products at once. The plan is cut every few steps.
    """
    if not 1 <= horizon <= 156:
        raise ValueError("horizon must be between 1 and 156 weeks")
    feats = written(split_chronological(lagged_features(panel), 0.85), "weekly")
    model = fit_boosted(feats.filter("split = 'train'"), WEEKLY, "sales_qty", trees)
    fit = trend_fit(panel, True)
    weights, sd = _blend(feats, model, fit)
    recent = panel.withColumn("age", F.row_number().over(newest_first())).filter(F.col("age") <= keep)
    hist = recent.groupBy(KEY).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("age")).alias("k"), F.col("sales_qty").alias("v")))).alias("h")  # at most `keep` values
    )
    state = hist.select(KEY, F.col("h.v").alias("hist")).join(fit, KEY).join(weights, KEY).join(sd, KEY)
    state = written(state.withColumn("path", F.array().cast("array<double>")), "state")
    share = F.col("line_share")
    base = state.columns
    for step in range(1, horizon + 1):
        df = _step_features(state.withColumn("date", F.date_add("last", 7 * step)))
        df = _scored(model, df, WEEKLY, "boosted")
        y = F.greatest(F.lit(0.0), share * trend_value("date", True) + (1 - share) * F.greatest(F.lit(0.0), F.col("boosted")))
        df = df.withColumn("y", y)
        df = df.withColumns(
            {"hist": _window_of(F.concat("hist", F.array("y")), keep), "path": F.concat("path", F.array("y"))}
        ).select(*base)
        state = written(df, "state") if step % 4 == 0 else df
    rows = state.select(KEY, "last", "sd", F.posexplode("path").alias("i", "yhat"))
    rows = rows.select(KEY, (F.col("i") + 1).alias("step"), F.date_add("last", (F.col("i") + 1) * 7).alias("date"), "yhat", "sd")
    out = rows.withColumns(
        {
            "yhat_lower": F.greatest(F.lit(0.0), F.col("yhat") - Z80 * F.col("sd")), "yhat_upper": F.col("yhat") + Z80 * F.col("sd"),
            "yhat_lower_95": F.greatest(F.lit(0.0), F.col("yhat") - Z95 * F.col("sd")), "yhat_upper_95": F.col("yhat") + Z95 * F.col("sd"),
        }
    )
    return rolling_pair_smooth(out).drop("sd")


ORIGIN = ["now", *[c for c in WEEKLY if c.startswith(("lag", "rolling"))]]
DIRECT = ["horizon", *ORIGIN, *[c for c in WEEKLY if c not in ORIGIN]]


def _toward(df: DataFrame) -> DataFrame:
    """Date that lies `horizon` weeks after `origin`, and its calendar features."""
    day = F.col("date")
    df = df.withColumn("date", F.date_add("origin", (F.col("horizon") * 7).cast("int")))
    df = df.withColumns({"month": F.month(day), "quarter": F.quarter(day), "year": F.year(day), "weekofyear": F.weekofyear(day)})
    return df.withColumns({**cyclic("month", F.month(day), 12), **cyclic("week", F.weekofyear(day), 52)})


def _drawn_horizons(horizon: int, draws: int) -> Column:
    """`draws` horizons of an origin, one from each equal part of 1 to `horizon`, by a hash of the row's key."""
    edges = [k * horizon // draws for k in range(draws + 1)]
    return F.array(*[
        (F.lit(lo + 1) + F.pmod(F.xxhash64(KEY, "origin", F.lit(k)), F.lit(hi - lo))).cast("int") for k, (lo, hi) in enumerate(zip(edges, edges[1:]))
    ])


def direct_pairs(panel: DataFrame, origins: DataFrame, horizon: int, draws: int, f: float) -> DataFrame:
    """Origins with the sales some weeks later and their split: targets in the last 1 - f of a product's weeks are held out.

    Every origin is paired with `draws` of its horizons, so pairs grow with the weeks and not with their square.
    """
    share = F.row_number().over(ordered()) / F.count(F.lit(1)).over(by())
    targets = panel.select(KEY, F.col(TIME).alias("date"), F.col("sales_qty").alias("actual"), F.when(share <= f, "train").otherwise("test").alias("split"))
    pairs = _toward(origins.withColumn("horizon", F.explode(_drawn_horizons(horizon, min(draws, horizon)))))
    return pairs.join(targets.where(F.col("actual").isNotNull()), [KEY, "date"])


def forecast_direct(panel: DataFrame, horizon: int = 156, trees: int = TREES, draws: int = 8) -> DataFrame:
    """Forecast of all products and weeks in one scoring pass: the horizon is a feature, and no prediction feeds another.

    A pooled boosted model learns sales from the state at an origin, the weeks ahead and the calendar of the target;
    it is blended with the seasonal line per product by held-out errors, as the recursion does. The line of that comparison is
    fitted on the weeks before the held-out ones. Jobs do not grow with the horizon.
    """
    if not 1 <= horizon <= 156:
        raise ValueError("horizon must be between 1 and 156 weeks")
    f = 0.85
    feats = weekly_features(panel.select(KEY, TIME, "sales_qty")).withColumns({"origin": F.col(TIME), "now": F.col("sales_qty")})
    origins = written(feats.select(KEY, "origin", *ORIGIN), "origins")
    pairs = written(direct_pairs(panel, origins, horizon, draws, f), "pairs")
    model = fit_boosted(pairs.filter("split = 'train'"), DIRECT, "actual", trees)
    known = trend_fit(panel.withColumn("__share", F.row_number().over(ordered()) / F.count(F.lit(1)).over(by())).where(F.col("__share") <= f), True)
    held = _scored(model, pairs.filter("split = 'test'"), DIRECT, "boosted").join(known, KEY).withColumn("line", trend_value("date", True))
    held = written(held.select(KEY, "actual", F.greatest(F.lit(0.0), "boosted").alias("boosted"), "line"), "held")
    base = {"line": BASE_WEIGHTS["prophet"], "boosted": BASE_WEIGHTS["xgb"] + BASE_WEIGHTS["lgbm"]}
    rmse = held.select(KEY, "actual", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in base])).alias("p"))
    scores = metrics(rmse.select(KEY, "actual", "p.*")).select(KEY, "model", "rmse")
    weights = ensemble_weights(scores, base).filter("model = 'line'").select(KEY, F.col("weight").alias("line_share"))
    share = F.coalesce("line_share", F.lit(base["line"]))
    mixed = lambda line, trees_: share * line + (1 - share) * trees_
    sd = held.join(weights, KEY).groupBy(KEY).agg(F.stddev_pop(F.col("actual") - mixed(F.col("line"), F.col("boosted"))).alias("sd"))
    newest = origins.withColumn("age", F.row_number().over(newest_first(KEY, "origin"))).filter("age = 1")
    fit = trend_fit(panel, True).join(weights, KEY, "left").join(sd, KEY, "left")
    steps = _toward(newest.join(fit, KEY).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon)))))
    y = mixed(trend_value("date", True), F.greatest(F.lit(0.0), "boosted"))
    out = _scored(model, steps, DIRECT, "boosted").select(KEY, F.col("horizon").alias("step"), "date", F.greatest(F.lit(0.0), y).alias("yhat"), "sd")
    return rolling_pair_smooth(out.select(KEY, "step", "date", "yhat", *bounds("yhat", "sd")))


def cross_validation_boosted(panel: DataFrame, folds: int = 5, horizon: int = 12, trees: int = 5) -> DataFrame:
    """Errors of a pooled boosted model over the expanding-window folds, one fit per fold."""
    feats = lagged_features(panel).drop("n")
    rows = written(fold_rows(panel, folds, horizon).select(KEY, TIME, "fold", "role").join(feats, [KEY, TIME]), "folds")
    out = None
    for k in range(1, folds + 1):
        fold = rows.filter(F.col("fold") == k)
        model = fit_boosted(fold.filter("role = 'train'"), WEEKLY, "sales_qty", trees)
        part = _scored(model, fold.filter("role = 'test'"), WEEKLY, "predicted").select(KEY, "fold", F.col("sales_qty").alias("actual"), "predicted")
        out = part if out is None else out.unionByName(part)
    return fold_summary(metrics(out.withColumn("model", F.lit("boosted")), (KEY, "fold", "model")))


# ---- scores of the blend

MEMBERS = {"line": BASE_WEIGHTS["prophet"], "boosted": BASE_WEIGHTS["xgb"], "forest": BASE_WEIGHTS["lgbm"]}


def trained_ensemble(panel: DataFrame, fit: float = 0.7, valid: float = 0.85, trees: int = TREES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, weights, importances) of the seasonal line, boosted trees, a forest and their blend, all fitted on the first weeks.

    Each product's weeks are split in order: the models learn from the first `fit` share, their weights per product come from
    errors up to the `valid` share, and predictions (product, week, model, predicted, actual) are of the weeks after it, so that no score
    has seen its own weeks. A product without weeks for weights keeps the base weights.
    """
    share = F.row_number().over(ordered()) / F.count(F.lit(1)).over(by())
    part = F.when(share <= fit, "fit").when(share <= valid, "valid").otherwise("test")
    feats = written(lagged_features(panel).withColumn("part", part).where(F.col("sales_qty").isNotNull()).select(KEY, TIME, "sales_qty", "part", *WEEKLY), "weekly")
    known = feats.filter("part = 'fit'")
    boosted = fit_boosted(known, WEEKLY, "sales_qty", trees)
    table = written(known.select(*[F.col(c).cast("double").alias(c) for c in WEEKLY], F.col("sales_qty").cast("double").alias("__y")), "forest")
    forest = RandomForestRegressor(featuresCol="features", labelCol="__y", numTrees=trees, maxDepth=2 * DEPTH, seed=SEED).fit(assembled(table, WEEKLY))
    held = _scored(forest, _scored(boosted, feats.filter("part <> 'fit'"), WEEKLY, "boosted"), WEEKLY, "forest").join(trend_fit(known, True), KEY)
    held = held.select(KEY, TIME, "part", F.col("sales_qty").alias("actual"), trend_value(TIME, True).alias("line"), F.greatest(F.lit(0.0), "boosted").alias("boosted"),
                       F.greatest(F.lit(0.0), "forest").alias("forest"))
    long = written(stacked(held, "model", "predicted", [(m, F.col(m)) for m in MEMBERS], keep=[KEY, TIME, "part", "actual"]), "held")
    test = long.filter("part = 'test'").drop("part")
    scores = metrics(long.filter("part = 'valid'")).select(KEY, "model", "rmse")
    named = test.select(KEY, "model").distinct().join(scores, [KEY, "model"], "left")
    weights = written(ensemble_weights(named, MEMBERS).withColumn("weight", F.when(F.col("rmse").isNull() & (F.sum("weight").over(by()) == 0), _base_weight()).otherwise(F.col("weight"))), "weights")
    blend = ensemble_blend(test.withColumnRenamed("predicted", "yhat"), weights).select(KEY, TIME, F.lit("ensemble").alias("model"), F.col("yhat").alias("predicted"))
    blend = blend.join(test.filter("model = 'line'").select(KEY, TIME, "actual"), [KEY, TIME]).select(*test.columns)
    tables = [importances(m, WEEKLY, panel.sparkSession).withColumn("model", F.lit(n)) for n, m in (("boosted", boosted), ("forest", forest))]
    return written(test.unionByName(blend), "predictions"), weights, tables[0].unionByName(tables[1])


def _base_weight() -> Column:
    out = F.lit(0.0)
    for name, weight in MEMBERS.items():
        out = F.when(F.col("model") == name, weight).otherwise(out)
    return out


def ensemble_importances(weights: DataFrame, imps: DataFrame) -> DataFrame:
    """Importances of the trained members by their mean weight over products, shares of 1 among them."""
    mean = weights.join(imps.select("model").distinct(), "model", "left_semi").groupBy("model").agg(F.avg("weight").alias("weight"))
    total = mean.agg(F.sum("weight").alias("total")).select("total").scalar()
    rows = imps.join(mean.withColumn("weight", F.col("weight") / total), "model")
    return rows.groupBy("feature").agg(F.sum(F.col("importance") * F.col("weight")).alias("importance"))


# ---- price model


MODEL_COLS = ["demand_forecast", "current_stock", "competitor", "seasonality_index", "day_of_week", "weekend", "brand_loyalty_score", "elasticity"]


def _price_inputs(ctx: DataFrame) -> DataFrame:
    return S.strategy_elasticity_prior(ctx).withColumns(
        {"competitor": F.when(F.col("competitor_price") > 0, F.col("competitor_price")).otherwise(F.col("current_price")),
         "weekend": F.col("is_weekend").cast("int")}
    )


def strategy_model(ctx: DataFrame, past: DataFrame, trees: int = TREES) -> DataFrame:
    """Price predicted by a forest trained on past contexts and the prices they had, within bounds."""
    rows = written(_price_inputs(past).select(*[F.col(c).cast("double").alias(c) for c in MODEL_COLS], F.col("current_price").alias("__y")), "prices")
    model = RandomForestRegressor(featuresCol="features", labelCol="__y", numTrees=trees, maxDepth=DEPTH, seed=SEED).fit(assembled(rows, MODEL_COLS))
    df = _scored(model, _price_inputs(ctx), MODEL_COLS, "predicted_price")
    price = S._clip(F.col("predicted_price"), S._floor_price(), S._top_price())
    weights = {n: float(v) * 100 for n, v in zip(MODEL_COLS, model.featureImportances.toArray())}
    drivers = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    return S._result(df, "deep_learning", price, S._at, F.lit("Price predicted by the forest"), drivers)


# ---- component scores and isolation


def scale_pca(df: DataFrame, k: int = 2, keep: list[str] = ()) -> DataFrame:
    """Scores of the first k principal components of the standardised numeric columns."""
    nums = project_numeric(df.drop(*keep)).columns
    inf = F.lit(float("inf"))
    clean = df.withColumns({c: F.when(F.abs(F.col(c).cast("double")) != inf, F.col(c).cast("double")) for c in nums})
    clean = fill_median(clean.select(*keep, *nums), nums)
    vec = assembled(written(clean, "numeric"), nums, "raw")
    scaled = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(vec).transform(vec)
    out = PCA(k=k, inputCol="scaled", outputCol="pc").fit(scaled).transform(scaled)
    n = vec.count()
    arr = F.transform(vector_to_array("pc"), lambda x: x * math.sqrt(n / max(n - 1, 1)))  # population deviations, as the scaler has sample ones
    return out.select(*keep, *[arr[i].alias(f"pc{i + 1}") for i in range(k)])


SAMPLE = 256
NODES = "tree int, node int, feature int, cut double, left int, right int, size int"


def _build_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one isolation tree: (node, feature or -1, cut, left, right, size)."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        idx, depth, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 + side] = me
        span = x[idx].max(axis=0) - x[idx].min(axis=0) if len(idx) else np.zeros(x.shape[1])
        open_ = np.flatnonzero(span > 0)
        if depth >= limit or len(idx) <= 1 or not len(open_):
            nodes.append([me, -1, 0.0, -1, -1, len(idx)])
            continue
        f = int(rng.choice(open_))
        cut = float(rng.uniform(x[idx, f].min(), x[idx, f].max()))
        nodes.append([me, f, cut, -1, -1, len(idx)])
        below = x[idx, f] <= cut
        todo += [(idx[below], depth + 1, me, 0), (idx[~below], depth + 1, me, 1)]
    return [tuple(n) for n in nodes]


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean search depth among n points, the correction for unsplit leaves."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    return np.where(big, 2 * (np.log(np.where(big, n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.where(n > 0, n, 1), out)


def isolation_scores(df: DataFrame, cols: list[str], keys: list[str], trees: int = 100, seed: int = SEED) -> DataFrame:
    """Isolation score in (0, 1) per row; higher is more isolated.

    A hash draws about trees * 256 rows whatever the size of the table; each tree is built
    from its own rows in its own task. The finished forest has a fixed maximum size
    (trees * 511 nodes), is broadcast, and scores the rows in Arrow batches.
    """
    spark = df.sparkSession
    rows = written(df.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]), "points")
    n = rows.count()
    space = 1 << 40
    share = min(1.0, 1.5 * SAMPLE / max(n, 1))
    # every tree draws from all rows by a hash of its own
    hit = lambda tree: F.pmod(F.xxhash64(*keys, tree, F.lit(seed)), F.lit(space)) < int(share * space)
    drawn = rows.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), hit)))
    pick = Window.partitionBy("tree").orderBy(F.xxhash64(*keys, "tree", F.lit(seed + 2)), *keys)
    drawn = drawn.withColumn("rn", F.row_number().over(pick)).filter(F.col("rn") <= SAMPLE)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("rn")[cols].to_numpy(dtype=float)
        nodes = _build_tree(x, np.random.default_rng([seed, t]))
        return pd.DataFrame([(t, *n_) for n_ in nodes], columns=["tree", "node", "feature", "cut", "left", "right", "size"])

    ship(drawn.sparkSession)
    forest = drawn.select("tree", "rn", *cols).groupBy("tree").applyInPandas(build, NODES).toPandas()
    grown = [g.sort_values("node") for _, g in forest.groupby("tree")]
    arrays = [tuple(g[c].to_numpy() for c in ("feature", "cut", "left", "right", "size")) for g in grown]
    shared = spark.sparkContext.broadcast(arrays)
    norm = float(_mean_path(np.array([min(SAMPLE, max(n, 2))]))[0])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            total = np.zeros(len(x))
            lines = np.arange(len(x))
            for feature, cut, left, right, size in shared.value:
                at = np.zeros(len(x), dtype=int)
                depth = np.zeros(len(x))
                moving = feature[at] >= 0
                while moving.any():
                    f = np.where(moving, feature[at], 0)
                    nxt = np.where(x[lines, f] <= cut[at], left[at], right[at])
                    at = np.where(moving, nxt, at)
                    depth += moving
                    moving = feature[at] >= 0
                total += depth + _mean_path(size[at])
            pdf["score"] = 2.0 ** (-(total / len(shared.value)) / norm)
            yield pdf[[*keys, "score"]]

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ship(rows.sparkSession)
    return written(rows.mapInPandas(score, ", ".join(f"{k} {types[k]}" for k in keys) + ", score double"), "scores")


def anomaly_isolation(df: DataFrame, cols: list[str], keys: list[str], share: float = 0.05, trees: int = 100, seed: int = SEED) -> DataFrame:
    """The most isolated `share` of all rows, labelled -1."""
    scores = isolation_scores(df, cols, keys, trees, seed)
    out = with_scalars(scores, quantile_row(scores, {"__cut": ("score", 1 - share)}))
    return out.withColumn("flag", F.when(F.col("score") > F.col("__cut"), -1).otherwise(1)).drop("__cut")


def isolation_by_product(panel: DataFrame, cols=("sales_qty", "price", "stock_on_hand"), trees: int = 100, min_n: int = 20) -> DataFrame:
    """0/1 isolation flag per row, each product cut at its own share max(.05, min(.2, 10 / n)).

    Columns are standardised within the product so that one forest serves all products.
    """
    p = by()
    z = {c: (F.coalesce(F.col(c), F.lit(0.0)) - F.avg(c).over(p)) / (F.stddev_samp(c).over(p) + 1e-9) for c in cols}
    rows = panel.withColumn("n", F.count(F.lit(1)).over(p)).filter(F.col("n") >= min_n).withColumns(z)
    scores = isolation_scores(rows, list(cols), [KEY, TIME], trees)
    n = F.count(F.lit(1)).over(p)
    rank = F.row_number().over(by().orderBy(F.col("score").desc(), TIME))
    share = clip_col(10 / n, 0.05, 0.2)
    ranked = scores.withColumns({"rank": rank, "take": F.floor(share * n)})
    return ranked.select(KEY, TIME, (F.col("rank") <= F.col("take")).cast("int").alias("flag"))


def seasonal_residual_flags(panel: DataFrame, min_n: int = 52) -> DataFrame:
    """0/1 flag per row: residual of the monthly line beyond 2.5 population deviations."""
    rows = panel.select(KEY, TIME, "sales_qty").join(trend_fit(panel, True), KEY)
    rows = rows.withColumns({"r": F.col("sales_qty") - trend_value(TIME, True), "n": F.count(F.lit(1)).over(by())})
    rows = rows.filter(F.col("n") >= min_n)
    return rows.select(KEY, TIME, (F.abs("r") > 2.5 * F.stddev_pop("r").over(by())).cast("int").alias("flag"))
