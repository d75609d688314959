"""Properties of the physical plans, and the full set of reports."""

import pytest

import __spark_entry__ as entry_module
from shelfspark.reports import build_reports, product_report, save_reports
from shelfspark.sources.panel import rollup

QUERIES = entry_module.queries()
CHEAP = [
    "product_summary", "stock_flags", "cross_scalar", "weeks_from_start", "filter_code_regex", "elasticity_gated", "pricing_opportunities",
    "profit_curve_50", "whatif_price", "elasticity_curve", "strategy_optimization", "strategy_state_action", "anomaly_hybrid", "anomaly_recent_flagged",
    "alerts_days", "stock_kpis", "stock_whatif", "stock_trajectory", "decompose_classical", "cross_validation", "scenario_growth", "scenario_multipliers",
    "year_week_compare", "semi_top_products", "importance_rollup", "exec_summary", "completion_report", "quick_summary", "describe_table", "column_profile",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", CHEAP)
def test_no_product_of_rows(spark, sf, key):
    text = plan(QUERIES[key](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time Python


def test_lines_are_hash_aggregated_and_pruned(tables):
    text = plan(rollup(tables.lineitem, tables.part))
    lines = [x for x in text.splitlines() if "FileScan" in x and "l_quantity" in x]
    assert len(lines) == 1 and "l_comment" not in lines[0] and "l_suppkey" not in lines[0]
    below = text[: text.index("BroadcastHashJoin")]
    assert below.count("HashAggregate") == 2 and "partial_sum(qty" in below[below.index("Exchange") :]


def test_filter_reaches_the_scan(spark, sf):
    text = plan(QUERIES["filter_product"](spark, sf))
    assert "EqualTo(product_name,Brand#11)" in text


def test_windows_of_the_features_share_one_shuffle(tables):
    from shelfspark.operators import windows as W

    exprs = {**W.lag_columns(), **W.strict_columns(), **W.price_columns(), **W.inventory_columns()}
    assert plan(tables.panel.withColumns(exprs)).count("Exchange hashpartitioning") == 1


def test_reports(spark, tables, tmp_path):
    paths = save_reports(tables.panel, str(tmp_path), 8)
    counts = {n: spark.read.parquet(p).count() for n, p in paths.items()}
    assert counts["cleaned_data"] == counts["features"] == tables.panel.count()
    assert counts["forecast"] == 8 * counts["pricing_opportunities"]
    report = spark.read.parquet(paths["completion_report"]).first()
    assert (report.alerts, report.anomalies) == (counts["inventory_alerts"], counts["sales_anomalies"])
    one = product_report(build_reports(tables.panel, 8), "Brand#11")
    assert one["forecast"].count() == 8
