"""Queries over trained models; they have no SQL twin except where a closed form exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY, TIME
from shelfspark.functions.stats import sized_join
from shelfspark.operators import anomaly as N
from shelfspark.operators import inventory as I
from shelfspark.operators import models as M
from shelfspark.operators import strategies as S
from shelfspark.operators.forecast import metrics, model_leaderboard
from shelfspark.plans.pricing import REC, contexts, members
from shelfspark.plans.registry import query
from shelfspark.session import written

query("train_boosted", "feature, importance:6", lambda t: M.train_boosted(M.lagged_features(t.panel))[0])
query("train_boosted_scores", "model, n:i, rmse:6, mae:6, mape:6, r2:6", lambda t: M.train_boosted(M.lagged_features(t.panel), f=0.85)[1])


def known_ahead(t):
    """Lagged features of a week with its calendar and what is planned for it."""
    return M.lagged_features(t.panel).join(t.panel.select(KEY, TIME, "price", "promotion", "holiday_flag"), [KEY, TIME])


query("train_validated", "model, feature, importance:6", lambda t: M.train_validated(known_ahead(t))[0])
query("train_validated_scores", "model, size:i, n:i, rmse:6, mae:6, mape:6, r2:6", lambda t: M.train_validated(known_ahead(t))[1])
query("demand_model", "kind, name, value:6", lambda t: M.demand_model(t.panel))
query("alerts_predicted_model", "product_name, stock:i, predicted_demand:6, status, days_to_stockout:i, suggested_reorder_qty:i",
      lambda t: I.alerts_predicted(t.panel, mode="model"))
query("forecast_recursive", "product_name, step:i, date:d, yhat:6, yhat_lower:6, yhat_upper:6, yhat_lower_95:6, yhat_upper_95:6",
      lambda t: M.forecast_recursive(t.panel, 12))
query("forecast_direct", "product_name, step:i, date:d, yhat:6, yhat_lower:6, yhat_upper:6, yhat_lower_95:6, yhat_upper_95:6",
      lambda t: M.forecast_direct(t.panel, 156))
query("ensemble_scores", "product_name, model, n:i, rmse:6, mae:6, mape:6, r2:6", lambda t: metrics(M.trained_ensemble(t.panel)[0]))
query("ensemble_leaderboard", "product_name, model, rmse:6, rank:i, improvement_pct:6, rmse_score:6, mae_score:6, mse_score:6, mape_score:6",
      lambda t: model_leaderboard(metrics(M.trained_ensemble(t.panel)[0])))
query("ensemble_importances", "feature, importance:6", lambda t: M.ensemble_importances(*M.trained_ensemble(t.panel)[1:]))
query("cross_validation_boosted", "product_name, model, folds:i, avg_rmse:6, std_rmse:6, avg_mae:6, avg_mape:6, avg_r2:6", lambda t: M.cross_validation_boosted(t.panel))


def past(t):
    """Every past week as a context: its price is what the forest learns."""
    p = t.panel
    cat = p.groupBy("category").agg(F.avg("price").alias("competitor_price"))
    prod = p.groupBy(KEY).agg(F.avg("sales_qty").alias("mq"))
    rows = sized_join(p, cat, "category", "inner").join(prod, KEY)
    none = F.lit(None).cast("double")
    names = F.when(F.col("category") == "CAT0", "luxury").when(F.col("category") == "CAT1", "necessity").when(
        F.col("category") == "CAT3", "discretionary").when(F.col("category") == "CAT4", "commodity").otherwise("general")
    return rows.select(
        F.col("price").alias("current_price"), F.col("stock_on_hand").alias("current_stock"), F.col("sales_qty").alias("demand_forecast"),
        "competitor_price", F.least(F.lit(1.3), F.greatest(F.lit(0.8), F.col("sales_qty") / F.col("mq"))).alias("seasonality_index"),
        names.alias("category"), F.lit(1.0).alias("price_sensitivity_score"), F.lit(0.5).alias("brand_loyalty_score"),
        (F.col("promotion") == 1).alias("is_promotion"), F.weekday(TIME).alias("day_of_week"), F.lit(False).alias("is_weekend"), none.alias("elasticity_estimate"),
    )


query("strategy_model", REC, lambda t: M.strategy_model(contexts(t), past(t)))


def learned_ensemble(t):
    """All eight members, the learned price model among them."""
    learned = past(t)
    return S.strategy_ensemble(written(contexts(t), "contexts"), members(t) | {"deep_learning": lambda df: M.strategy_model(df, learned)})


query("strategy_ensemble_learned", f"{REC}, low_price:6, high_price:6", learned_ensemble)
query("scale_pca", "product_name, week_start:d, pc1:6, pc2:6", lambda t: M.scale_pca(t.panel, 2, [KEY, TIME]))
query("anomaly_isolation", "product_name, week_start:d, score:6, flag:i",
      lambda t: M.anomaly_isolation(M.scale_pca(t.panel, 2, [KEY, TIME]), ["pc1", "pc2"], [KEY, TIME]))
query("anomaly_one_class_components", "product_name, week_start:d, distance:6, flag:i",
      lambda t: N.anomaly_one_class(M.scale_pca(t.panel, 2, [KEY, TIME]), ["pc1", "pc2"]))
query("anomaly_hybrid_full", "product_name, date:d, actual_sales, expected_sales:6, deviation_pct:6, severity, suggested_action, confidence:2",
      lambda t: N.anomaly_hybrid(t.panel, M.isolation_by_product(t.panel), M.seasonal_residual_flags(t.panel)))
