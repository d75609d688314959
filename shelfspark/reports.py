"""The business tables of a full run, built from one weekly panel and written in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.expr import KEY
from shelfspark.operators import aggregates as A
from shelfspark.operators import anomaly as N
from shelfspark.operators import cleaning as C
from shelfspark.operators import filters as P
from shelfspark.operators import forecast as O
from shelfspark.operators import inventory as I
from shelfspark.operators import pricing as E
from shelfspark.operators import windows as W


def build_reports(panel: DataFrame, horizon: int = 52) -> dict[str, DataFrame]:
    """Cleaned rows, features, alerts, anomalies, seasons, prices, forecast and their counts."""
    cleaned = P.binary_flags(C.impute_mean_mode(panel))
    elasticity = E.elasticity_gated(panel)
    tables = {
        "cleaned_data": P.revenue(cleaned),
        "features": W.feature_table(panel),
        "inventory_alerts": I.sort_custom_rank(I.alerts_weeks(panel)),
        "sales_anomalies": N.anomaly_hybrid(panel),
        "seasonal_insights": A.category_seasonality(panel),
        "price_tests": E.priority_rank(E.price_sensitivity(panel)),
        "pricing_opportunities": E.pricing_opportunities(panel, elasticity),
        "price_zones": E.price_zones(panel, elasticity),
        "forecast": O.forecast_trend_season(panel, horizon),
        "model_scores": O.model_leaderboard(O.metrics(O.baseline_predictions(panel))),
    }
    counted = {"alerts": "inventory_alerts", "anomalies": "sales_anomalies", "seasonal": "seasonal_insights", "pricing": "pricing_opportunities"}
    tables["completion_report"] = A.completion_report(**{k: tables[v] for k, v in counted.items()})
    return tables


def save_reports(panel: DataFrame, path: str, horizon: int = 52) -> dict[str, str]:
    """Write every report under `path` and return where each one lies."""
    out = {}
    for name, df in build_reports(panel, horizon).items():
        out[name] = f"{path.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(out[name])
    return out


def product_report(tables: dict[str, DataFrame], product: str) -> dict[str, DataFrame]:
    """The rows of one product from every table that has products."""
    return {n: df.filter(F.col(KEY) == product) for n, df in tables.items() if KEY in df.columns}
