"""Every report and summary runs on empty tables and keeps its columns."""

from __future__ import annotations

import pytest

from tillwise.operators import OPERATORS, dashboard

DAY = "2001-08-02"


@pytest.fixture(scope="module")
def empty(make_store):
    return make_store()


@pytest.mark.parametrize("name", list(OPERATORS))
def test_report_on_empty_tables(empty, shop, name):
    report = OPERATORS[name](empty, DAY)
    filled = OPERATORS[name](shop.store(), DAY)
    assert report.dtypes == filled.dtypes
    assert len(report.collect()) <= 4


def test_summaries_on_empty_reports(empty, spark):
    def run(name):
        return OPERATORS[name](empty, DAY)

    clv, rfm, health, matrix = map(run, ("customer_lifetime_values", "rfm_segments", "customer_health_scores", "product_performance_matrix"))
    assert dashboard.mrr_growth(run("current_mrr_breakdown")).first()["growth_rate"] is None
    assert dashboard.average_renewal_rate(run("renewal_rates_by_month")).first()[0] is None
    assert set(dashboard.refund_trailing_summary(run("refund_rates_by_month"), run("refunded_revenue_by_month")).first()) == {None}
    assert tuple(dashboard.customer_summary(clv, rfm, health).first()) == (0, 0.0, 0)
    assert [r["customer_count"] for r in dashboard.rfm_bucket_counts(rfm).collect()] == [0] * 7
    assert dashboard.health_distribution(health).collect() == []
    assert dashboard.top_clv_rows(clv).collect() == []
    assert dashboard.product_summary(matrix, matrix).first()["total_revenue"] is None
    assert dashboard.bcg_quadrant(matrix, matrix).collect() == []
    assert dashboard.product_search(run("top_products"), quadrant="dogs").collect() == []
    sources = spark.createDataFrame([], "source string, revenue double")
    assert tuple(dashboard.recurring_share(sources).first()) == (0.0, 0.0, 0.0, "poor")
    assert [r["value"] for r in dashboard.revenue_waterfall(sources).collect()] == [0.0] * 6
    assert dashboard.revenue_by_source_share(sources).collect() == []
    assert dashboard.latest_daily_revenue(spark.createDataFrame([], "date date, revenue double")).first()[0] == 0.0
    assert dashboard.cohort_heatmap(spark.createDataFrame([], "cohort string, month_number int, revenue double")).collect() == []
    assert dashboard.pareto(spark.createDataFrame([], "id long, revenue decimal(18,2)")).collect() == []
