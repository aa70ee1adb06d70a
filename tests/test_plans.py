"""Shape of the physical plans, with size-based broadcasts off as for large tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tillwise import Store
from tillwise.operators import OPERATORS
from tillwise.plans.sales import totals_apart
from tillwise.sources.sample_views import AS_OF

# Reports that may sort one partition: their window runs over one row per month,
# or over one row per super-block of amounts.
SINGLE_TASK_WINDOWS = {"revenue_velocity", "revenue_forecast", "seasonal_patterns", "clv_distribution", "revenue_concentration"}
# Full scans of the item table that each report needs.
ITEM_SCANS = {
    "top_products": 1,
    "product_growth_trends": 1,
    "product_lifecycle_stages": 1,
    "profitability_by_segment": 1,
    "demand_forecast": 1,
    "revenue_concentration": 1,
    "product_performance_matrix": 1,
    "bundle_performance": 1,
}
# The only joins without a key: one-row totals, broadcast.
ONE_ROW_JOINS = {
    "clv_distribution": 2,
    "revenue_concentration": 1,
    "product_performance_matrix": 1,
    "cash_flow_projection": 1,
    "ltv_cac_ratio": 2,
    "revenue_run_rate": 3,
    "financial_health_indicators": 2,
}


@pytest.fixture(scope="module")
def stored(spark, shop, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("shop") / "store")
    shop.store().write_parquet(root)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield Store.from_parquet(spark, root)
    for key in keys:
        spark.conf.unset(key)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    """The plan with complete scan filters (the plain text cuts them to a width)."""
    modes = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return df._jdf.queryExecution().explainString(modes.fromString("formatted"))


@pytest.mark.parametrize("name", list(OPERATORS))
def test_plan_has_no_bottleneck(stored, name):
    report = OPERATORS[name](stored, AS_OF)
    plan = plan_of(report)
    assert "CartesianProduct" not in plan
    assert "Python" not in plan and "Pandas" not in plan
    # every keyless join has a global aggregate of one row on its broadcast side
    assert len(re.findall(r"BroadcastNestedLoopJoin BuildRight, Cross", plan)) == plan.count("BroadcastNestedLoopJoin")
    assert bool(plan.count("BroadcastNestedLoopJoin")) == (name in ONE_ROW_JOINS)
    windows = re.findall(r"windowspecdefinition\(([^)]*?)(?:, specified)", plan)
    single = "Exchange SinglePartition" in plan and any(" ASC" in w.split(",")[0] for w in windows)
    assert not single or name in SINGLE_TASK_WINDOWS
    # unlimited sorting of customers into one task would show as a global limit
    assert "GlobalLimit" not in plan or name == "revenue_run_rate"
    assert "Expand" not in plan  # no row multiplication for distinct counts
    # equal sub-plans are merged while running
    report.collect()
    final = plan_of(report).split("== Initial Plan ==")[0]
    items = len(re.findall(r"FileScan parquet \[[^\]]*product_id#", final))
    assert items == ITEM_SCANS.get(name, 0)


def test_ranges_and_columns_reach_the_scan(stored):
    scan = formatted(OPERATORS["revenue_by_month"](stored, AS_OF, "2000-01-01", "2000-12-31"))
    assert "ReadSchema: struct<status:string,type:string,total:decimal(18,2),date_created:timestamp>" in scan
    assert "GreaterThanOrEqual(date_created,2000-01-01" in scan
    assert "LessThanOrEqual(date_created,2000-12-31" in scan
    assert "In(status, [complete,edd_subscription])" in scan and "In(type, [renewal,sale])" in scan


@pytest.mark.parametrize(
    "name, bound",
    [
        ("refund_rates_by_month", "GreaterThanOrEqual(date_created,2000-03-01"),
        ("new_customers_yoy_change", "GreaterThanOrEqual(date_created,2000-01-01"),
        ("revenue_run_rate", "GreaterThanOrEqual(date_created,2001-05-02"),
        ("revenue_forecast", "GreaterThanOrEqual(date_created,2000-08-02"),
        ("seasonal_patterns", "GreaterThanOrEqual(date_created,1999-08-02"),
        ("demand_forecast", "GreaterThanOrEqual(date_created,2001-05-04"),
        ("upcoming_renewals", "GreaterThanOrEqual(expiration,2001-08-02"),
        ("renewal_rates_by_month", "GreaterThanOrEqual(date_created,2016-01-01"),
    ],
)
def test_rolling_windows_reach_the_scan(stored, name, bound):
    given = {
        "refund_rates_by_month": {"start": "2000-03-05"},
        "renewal_rates_by_month": {"cohort_first_day": "2015-01-01"},
    }
    assert bound in formatted(OPERATORS[name](stored, AS_OF, **given.get(name, {})))


def test_counting_orders_needs_no_further_shuffle(stored):
    """The per-order aggregation reuses the placement the join already made."""
    plan = plan_of(OPERATORS["top_products"](stored, AS_OF))
    exchanges = re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (\w+\([^,)]*)", plan)
    assert sum(e.startswith("hashpartitioning(order_id") for e in exchanges) == 2
    assert sum(e.startswith("hashpartitioning(product_id") for e in exchanges) == 3


SKEW_SETTINGS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
}


@pytest.mark.parametrize("name", ["top_products", "product_lifecycle_stages", "bundle_performance"])
def test_hot_order_is_split(stored, spark, tmp_path, name):
    """A third of all items in one order: the join is split, the result stays the same."""
    items = spark.range(0, 60_000, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 4 ELSE id % 1500 END AS order_id", "xxhash64(id) % 90 + 90 AS product_id",
        "CAST(id % 5 AS INT) AS quantity", "CAST(id % 700 AS DECIMAL(18,2)) AS total",
    )
    items.write.parquet(f"{tmp_path}/items")
    store = stored.with_tables(order_items=spark.read.parquet(f"{tmp_path}/items"))
    plain = OPERATORS[name](store, AS_OF).collect()
    before = {key: spark.conf.get(key, None) for key in SKEW_SETTINGS}
    try:
        for key, value in SKEW_SETTINGS.items():
            spark.conf.set(key, value)
        report = OPERATORS[name](store, AS_OF)
        found = report.collect()
        final = plan_of(report).split("== Initial Plan ==")[0]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert found == plain
    assert "SortMergeJoin(skew=true)" in final


def final_plan(df) -> str:
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


def shuffles(plan: str) -> int:
    """Shuffles that are made, without those that are used again."""
    return len(re.findall(r"- Exchange (?!.*Reused)", plan))


def scans(plan: str) -> list[str]:
    return sorted(re.findall(r"/store/(\w+)\]", plan))


@pytest.mark.parametrize(
    "name, tables, most",
    [
        ("revenue_concentration", ["customers", "order_items", "orders", "orders"], 15),
        ("product_performance_matrix", ["order_items", "orders", "products"], 6),
        ("bundle_performance", ["order_items", "orders", "product_meta", "products"], 10),
        ("revenue_by_region", ["order_addresses", "orders"], 5),
        ("customers_by_country", ["customers", "order_addresses", "orders"], 6),
        ("revenue_breakdown", ["orders"], 10),
        ("failed_payment_recovery", ["orders"], 10),
    ],
)
def test_tables_are_read_and_shuffled_once(stored, name, tables, most):
    plan = final_plan(OPERATORS[name](stored, AS_OF))
    assert scans(plan) == tables
    assert shuffles(plan) <= most


@pytest.mark.parametrize("name", ["revenue_by_region", "customers_by_country"])
def test_addresses_are_placed_once(stored, name):
    plan = plan_of(OPERATORS[name](stored, AS_OF))
    assert len(re.findall(r"- Exchange hashpartitioning\(order_id#\d+L?, ", plan)) == 2  # orders, addresses
    assert not re.findall(r"- Exchange hashpartitioning\(order_id#\d+L?, place", plan)


def test_old_orders_are_not_asked_when_recent_ones_exist(stored, spark):
    report = OPERATORS["revenue_run_rate"](stored, AS_OF)
    plan = final_plan(report)
    assert scans(plan) == ["orders", "subscriptions"]
    (row,) = report.collect()
    assert row["annual_run_rate"] > 0
    # long after the last order: old orders are asked whether there ever was one
    later = OPERATORS["revenue_run_rate"](stored, "2010-01-01")
    assert scans(final_plan(later)).count("orders") > 1
    (row,) = later.collect()
    assert row["annual_run_rate"] == 0
    empty = stored.with_tables(orders=stored.orders.filter("false"))
    assert OPERATORS["revenue_run_rate"](empty, AS_OF).first()["annual_run_rate"] is None


def skewed(spark, build):
    """Final plan and rows of ``build()`` while small partitions already count as skewed."""
    before = {key: spark.conf.get(key, None) for key in SKEW_SETTINGS}
    try:
        for key, value in SKEW_SETTINGS.items():
            spark.conf.set(key, value)
        report = build()
        found = report.collect()
        return plan_of(report).split("== Initial Plan ==")[0], found
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_keys_are_split_beside_totals(stored, spark, tmp_path):
    """Joins of raw rows to an aggregate on the same key, most rows on one key."""
    spark.range(0, 60_000, 1, 8).selectExpr("CASE WHEN id % 10 < 9 THEN 4 ELSE id % 1500 END AS k", "id AS v").write.parquet(f"{tmp_path}/raw")
    raw = spark.read.parquet(f"{tmp_path}/raw")
    for how in ("inner", "left", "left_anti"):
        plan, _ = skewed(spark, lambda: raw.join(totals_apart(raw, ["k"], F.max("v").alias("most")), "k", how))
        assert "SortMergeJoin(skew=true)" in plan
        plain, _ = skewed(spark, lambda: raw.join(raw.groupBy("k").agg(F.max("v").alias("most")), "k", how))
        assert "SortMergeJoin(skew=true)" not in plain
    assert totals_apart(raw, ["k"]).columns == ["k"]


@pytest.mark.parametrize("name", ["mrr_by_month", "bundle_performance", "customer_acquisition_channels", "revenue_breakdown", "failed_payment_recovery"])
def test_reports_split_their_hot_keys(stored, spark, tmp_path, name):
    """One product, first payment, e-mail address or customer has most rows; the report stays the same."""
    rows = spark.range(0, 60_000, 1, 8)
    if name == "mrr_by_month":
        tables = {"subscriptions": rows.selectExpr(
            "id", "id AS customer_id", "CASE WHEN id % 10 < 9 THEN NULL ELSE id END AS parent_payment_id", "'active' AS status",
            "CAST(5 AS DECIMAL(18,2)) AS initial_amount", "CAST(5 AS DECIMAL(18,2)) AS recurring_amount",
            "TIMESTAMP'2001-01-01 00:00:00' + (id % 100) * INTERVAL '1' DAY AS created", "TIMESTAMP'2002-01-01 00:00:00' AS expiration")}
    elif name == "bundle_performance":
        tables = {
            "orders": stored.orders.limit(1).drop("id", "customer_id").crossJoin(rows.selectExpr("id", "id % 900 AS customer_id")).withColumn("status", F.lit("complete")),
            "order_items": rows.selectExpr(
                "id AS order_id", "CASE WHEN id % 10 < 9 THEN 35 ELSE id % 90 END AS product_id", "1 AS quantity", "CAST(id % 7 AS DECIMAL(18,2)) AS total"),
        }
    elif name == "customer_acquisition_channels":
        tables = {"customers": rows.selectExpr(
            "id", "CASE WHEN id % 10 < 9 THEN 'c1@shop.test' ELSE concat('c', id, '@shop.test') END AS email", "'n' AS name",
            "TIMESTAMP'2001-01-01 00:00:00' AS date_created", "1L AS purchase_count", "CAST(5 AS DECIMAL(18,2)) AS purchase_value")}
    else:
        tables = {"orders": rows.selectExpr(
            "id", "0L AS parent", "CASE WHEN id % 10 < 9 THEN 1 ELSE id END AS customer_id",
            "CASE WHEN id % 5 = 0 THEN 'failed' ELSE 'complete' END AS status", "'sale' AS type", "'g' AS gateway", "'e' AS email", "'i' AS ip",
            "CAST(id % 9 AS DECIMAL(18,2)) AS total", "TIMESTAMP'2001-03-01 10:00:00' + (id * 53 % 3600000) * INTERVAL '0.001' SECOND AS date_created")}
    for table, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{table}")
    store = stored.with_tables(**{table: spark.read.parquet(f"{tmp_path}/{table}") for table in tables})
    plain = OPERATORS[name](store, AS_OF).collect()
    plan, found = skewed(spark, lambda: OPERATORS[name](store, AS_OF))
    assert found == plain
    if name in ("revenue_breakdown", "failed_payment_recovery"):
        # spread by blocks of time from the start: rows are never placed by customer alone
        assert not re.findall(r"- Exchange hashpartitioning\((?:owner|customer_id)#\d+L?, \d+\)", plan)
    else:
        assert "SortMergeJoin(skew=true)" in plan
