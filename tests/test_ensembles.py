"""The trained blend and the eight-member price ensemble: invariants."""

from pyspark.sql import functions as F

from shelfspark.operators import models as M
from shelfspark.operators import strategies as S
from shelfspark.operators.forecast import metrics
from shelfspark.plans import models as P
from shelfspark.plans.pricing import members


def test_trained_blend(spark, tables):
    preds, weights, imps = M.trained_ensemble(tables.panel, trees=3)
    assert preds.groupBy("product_name", "week_start", "model").count().where("count > 1").isEmpty()
    late = tables.panel.withColumn("r", F.percent_rank().over(M.by().orderBy("week_start"))).where("r < 0.8").select("product_name", "week_start")
    assert preds.join(late, ["product_name", "week_start"]).isEmpty()  # only weeks that neither models nor weights have seen
    assert all(abs(r.w - 1) < 1e-9 for r in weights.groupBy("product_name").agg(F.sum("weight").alias("w")).collect())
    wide = preds.groupBy("product_name", "week_start").pivot("model", ["line", "boosted", "forest", "ensemble"]).agg(F.first("predicted")).collect()
    for r in wide:
        assert min(r.line, r.boosted, r.forest) - 1e-9 <= r.ensemble <= max(r.line, r.boosted, r.forest) + 1e-9
    total = {r.model: r.rmse for r in metrics(preds, ("model",)).collect()}
    assert total["ensemble"] <= max(total[m] for m in M.MEMBERS)
    assert abs(M.ensemble_importances(weights, imps).agg(F.sum("importance")).first()[0] - 1) < 1e-9


def test_short_products_keep_base_weights(spark):
    rows = [("long", i, float(20 + i % 5)) for i in range(60)] + [("short", i, 5.0 + i) for i in range(6)]
    df = spark.createDataFrame(rows, "product_name string, i int, sales_qty double")
    panel = df.select("product_name", F.date_add(F.lit("2024-01-01").cast("date"), F.col("i") * 7).alias("week_start"), "sales_qty")
    _, weights, _ = M.trained_ensemble(panel, trees=2)
    got = {(r.product_name, r.model): r.weight for r in weights.collect()}
    assert set(m for p, m in got if p == "long") == set(M.MEMBERS)
    assert all(abs(sum(w for (q, _), w in got.items() if q == p) - 1) < 1e-9 for p in {q for q, _ in got})


def test_learned_member_moves_the_price(spark, tables):
    eight = P.learned_ensemble(tables).select("product_id", "recommended_price", "low_price", "high_price")
    seven = S.strategy_ensemble(P.contexts(tables), members(tables)).select("product_id", F.col("recommended_price").alias("without"))
    both = eight.join(seven, "product_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("recommended_price") - F.col("without")) > 1e-6).alias("moved"),
        F.count_if((F.col("recommended_price") < F.col("low_price") - 1e-4) | (F.col("recommended_price") > F.col("high_price") + 1e-4)).alias("outside"),
    ).first()
    assert both.n == tables.panel.count() and both.moved > both.n / 2 and both.outside == 0


def test_validated_boosting_stops_early_and_beats_the_mean(spark, tables):
    features = P.known_ahead(tables)
    imps, scores = M.train_validated(features, trees=15)
    total = {r.model: r.s for r in imps.groupBy("model").agg(F.sum("importance").alias("s")).collect()}
    assert all(abs(s - 1) < 1e-6 for s in total.values()) and set(total) == {"boosted", "forest"}
    by_model = {r.model: r for r in scores.collect()}
    assert 1 <= by_model["boosted"]["size"] < 15 and by_model["forest"]["size"] == 15
    assert max(by_model[m].rmse for m in total) < by_model["mean4"].rmse
    few = M.train_validated(features, cols=["lag_1", "rolling_mean_4"], trees=2)[0]
    assert {r.feature for r in few.collect()} == {"lag_1", "rolling_mean_4"}
