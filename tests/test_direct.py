"""The direct forecast: whole horizons, one scoring pass, errors beside the recursion's."""

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import models as M


def jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def rmse(forecast, late):
    both = forecast.join(late.select("product_name", F.col("week_start").alias("date"), "sales_qty"), ["product_name", "date"])
    return both.agg(F.sqrt(F.avg((F.col("yhat") - F.col("sales_qty")) ** 2))).first()[0]


def test_jobs_do_not_grow_with_the_horizon(spark, tables):
    few = tables.panel.where("product_name < 'Brand#15'")
    counts = [jobs(spark, f"direct-{h}", lambda h=h: M.forecast_direct(few, h, trees=2).collect()) for h in (8, 104)]
    assert abs(counts[0] - counts[1]) <= 2  # adaptive stages may differ by a small table


def test_every_step_of_every_product(spark, tables):
    rows = M.forecast_direct(tables.panel.where("product_name < 'Brand#15'"), 156, trees=2)
    n = tables.panel.where("product_name < 'Brand#15'").select("product_name").distinct().count()
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("product_name", "step").alias("d"), F.min("yhat").alias("low"),
                   F.sum(F.when(F.col("yhat_lower") > F.col("yhat_upper"), 1).otherwise(0)).alias("bad")).first()
    assert (got.n, got.d, got.bad) == (156 * n, 156 * n, 0) and got.low >= 0
    with pytest.raises(ValueError):
        M.forecast_direct(tables.panel, 157)


def test_error_at_twelve_weeks_is_not_above_the_recursion(spark, tables):
    panel = tables.panel
    cut = F.date_sub(panel.agg(F.max("week_start").alias("m")).select("m").scalar(), 84)
    past, late = panel.where(F.col("week_start") <= cut), panel.where(F.col("week_start") > cut)
    assert rmse(M.forecast_direct(past, 12), late) <= 1.02 * rmse(M.forecast_recursive(past, 12), late)
