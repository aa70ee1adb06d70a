from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tillwise.operators import OPERATORS, dashboard
from tillwise.sources.sample_views import AS_OF

PERIOD = ("period string, total_revenue double, revenue_change double, churn_rate double, current_mrr double,"
          " mrr_growth double, new_customers long, customer_change double")


@pytest.fixture(scope="module")
def periods(spark):
    return spark.createDataFrame(
        [
            ("good", 100.0, 60.0, 1.0, 10.0, 50.0, 60, 50.0),
            ("quiet", 100.0, 0.0, 6.0, 10.0, 0.0, 10, 0.0),
            ("bad", 100.0, -60.0, 12.5, 10.0, -60.0, 10, -50.0),
            ("none", None, None, None, None, None, None, None),
            ("worst", 1.0, -50.0, 11.0, 1.0, -50.0, 1, -50.0),
        ],
        PERIOD,
    )


def test_health_score(periods):
    found = {r["period"]: (r["health_score"], r["status"]) for r in rows_of(dashboard.business_health_score(periods))}
    assert found == {
        "good": (98, "Excellent"),  # 35 + 22.5 + 25 + 15 = 97.5
        "quiet": (48, "Needs Attention"),  # 17.5 + 10 + 12.5 + 7.5 = 47.5
        "bad": (-6, "Critical"),
        "none": (63, "Good"),  # 17.5 + 25 + 12.5 + 7.5 = 62.5
        "worst": (0, "Loading..."),
    }


def test_quick_wins(periods):
    found = {}
    for r in rows_of(dashboard.quick_wins(periods)):
        found.setdefault(r["period"], []).append((r["title"], r["description"]))
    assert found["good"] == [
        ("Strong Revenue Growth", "Revenue up 60.0% vs previous period"),
        ("MRR Expanding", "MRR growing 50.0% month-over-month"),
        ("Low Churn Rate", "Customer retention at 99.0%"),
        ("Customer Acquisition", "60 new customers this period"),
    ]
    assert found["none"] == [("Low Churn Rate", "Customer retention at 100.0%")]
    assert found["quiet"] == found["worst"] == [
        ("Steady Performance", "Continue monitoring key metrics for opportunities")]


def test_risk_alerts(periods):
    found = [(r["period"], r["severity"], r["title"], r["description"]) for r in rows_of(dashboard.risk_alerts(periods))]
    assert found[:3] == [
        ("bad", "high", "High Churn Rate", "12.5% monthly churn needs immediate attention"),
        ("bad", "high", "Revenue Decline", "Revenue down 60.0% from previous period"),
        ("bad", "medium", "MRR Contraction", "MRR declining 60.0%"),
    ]
    assert {f[0] for f in found} == {"bad", "worst"}


def test_growth_without_existing_mrr_is_null(spark):
    df = spark.createDataFrame([(5.0, 0.0, 2.0, 3.0)], "new_mrr double, existing_mrr double, churned_mrr double, net_mrr double")
    assert rows_of(dashboard.mrr_growth(df)) == [{"growth_rate": None, "net_new_mrr": 3.0}]


def test_trailing_summary_takes_the_last_twelve_rows(spark):
    rates = spark.createDataFrame([(f"2000-{m:02d}", float(m)) for m in range(1, 13)] + [("2001-01", 40.0)], "month_year string, refund_rate double")
    money = spark.createDataFrame([(f"2000-{m:02d}-01", 1.0) for m in range(1, 13)] + [("2001-01-01", 5.0)], "date string, value double")
    (row,) = rows_of(dashboard.refund_trailing_summary(rates, money))
    assert row == {"avg_refund_rate": (77 + 40) / 12, "last_refund_rate": 40.0, "refunded_revenue": 16.0, "last_refunded_revenue": 5.0}


def test_names_and_unknown_status(spark):
    clv = spark.createDataFrame([(1, "a@b", "", 5.0, 2.5, 2), (2, "c@d", "Cy", 7.0, None, 1)],
                                "customer_id long, email string, name string, total_spent double, avg_order_value double, purchase_count long")
    assert [(r["name"], r["aov"]) for r in rows_of(dashboard.top_clv_rows(clv))] == [("Cy", 0.0), ("a@b", 2.5)]
    health = spark.createDataFrame([("Good",), (None,), ("",), ("Good",)], "health_status string")
    assert {r["health_status"]: r["customer_count"] for r in rows_of(dashboard.health_distribution(health))} == {"Good": 2, "Unknown": 2}


def test_product_search(spark):
    df = spark.createDataFrame(
        [(1, "Blue Hat", 10.0, 5.0), (2, "blue cap", 30.0, -5.0), (3, "BLUE tie", 20.0, None), (4, "red hat", 99.0, 1.0), (5, None, 1.0, 1.0)],
        "product_id long, product_name string, total_revenue double, growth_rate double")

    def ids(**how):
        return [r["product_id"] for r in rows_of(dashboard.product_search(df, **how))]

    assert ids(term="BLUE") == [2, 3, 1]
    assert ids(term="blue", sort="growth_rate", descending=False) == [2, 3, 1]
    assert ids() == [4, 2, 3, 1, 5]
    # means over the blue rows: revenue 20, growth 0
    assert [ids(term="blue", quadrant=q) for q in ("stars", "cash-cows", "question-marks", "dogs")] == [[3], [2], [1], []]
    with pytest.raises(ValueError):
        dashboard.product_search(df, quadrant="cats")


def test_trend_classes(spark):
    df = spark.createDataFrame([(5.01,), (5.0,), (-5.0,), (-5.01,), (None,)], "growth_rate double")
    assert [r["trend"] for r in rows_of(dashboard.with_trend_class(df))] == ["up", "flat", "flat", "down", "flat"]


@pytest.mark.parametrize("velocity, grade", [(5.1, "excellent"), (5, "good"), (2, "fair"), (0, "poor"), (None, "poor"), (-1, "poor")])
def test_velocity_grades(spark, velocity, grade):
    df = spark.createDataFrame([("recurring", 30.0), ("new", 70.0)], "source string, revenue double")
    (row,) = rows_of(dashboard.recurring_share(df, velocity))
    assert (row["total"], row["recurring_percentage"], row["health"]) == (100.0, 30.0, grade)


def test_waterfall_fills_missing_steps(spark):
    df = spark.createDataFrame([("starting", 100.0), ("new", 20.0), ("churn", 30.0)], "source string, revenue double")
    assert [(r["step"], r["value"]) for r in rows_of(dashboard.revenue_waterfall(df))] == [
        ("Starting", 100.0), ("New Sales", 20.0), ("Expansion", 0.0), ("Contraction", 0.0), ("Churn", -30.0), ("Ending", 90.0)]


def test_heatmap_positions_are_dense(spark):
    df = spark.createDataFrame([("2001-03", 7, 1.0), ("2001-01", 2, 5.0), ("2001-01", 7, None)], "cohort string, month_number int, revenue double")
    found = {(r["month_idx"], r["cohort_idx"], r["revenue"], r["max_revenue"]) for r in rows_of(dashboard.cohort_heatmap(df))}
    assert found == {(1, 1, 1.0, 5.0), (0, 0, 5.0, 5.0), (1, 0, 0.0, 5.0)}


def test_invariants(shop):
    store = shop.store()

    def run(name, **params):
        return OPERATORS[name](store, AS_OF, **params)

    segments = {r["segment"]: r["customer_count"] for r in rows_of(run("segment_performance"))}
    buckets = {r["segment"]: r["customer_count"] for r in rows_of(dashboard.rfm_bucket_counts(run("rfm_segments")))}
    assert {k: v for k, v in buckets.items() if v} == segments and len(buckets) == 7
    for r in rows_of(run("revenue_by_month")):
        assert r["new_revenue"] + r["recurring_revenue"] == r["total_revenue"]
    for r in rows_of(run("revenue_breakdown")):
        assert r["new_customer_revenue"] + r["existing_customer_revenue"] + r["renewal_revenue"] == r["total_revenue"]
        assert r["upgrade_revenue"] <= r["existing_customer_revenue"]
    spenders = run("customer_health_scores", limit=None).filter(F.col("total_spent") > 0).count()
    assert sum(r["customer_count"] for r in rows_of(run("clv_distribution"))) == spenders
    regions = run("revenue_by_region").agg(F.sum("total_revenue")).first()[0]
    assert regions >= run("revenue_by_month").agg(F.sum("total_revenue")).first()[0]
