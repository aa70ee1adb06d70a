"""Cash flow, profitability, run rate, health indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions import fixed_values as fv
from tillwise.functions.dates import (
    Day,
    at,
    is_within,
    non_negative,
    required_day,
    shift_days,
    shift_months,
    within,
)
from tillwise.functions.labels import first_match, graded, is_paid
from tillwise.functions.numbers import leading_number, money_sum, percent, percent_change, ratio, rounded, rounded_ratio
from tillwise.operators.products import bundle_marks, meta_rows, split_by_type
from tillwise.plans.prefix import all_read
from tillwise.plans.sales import count_if, paid_orders, rows, sold_items, sum_if
from tillwise.sources.store import Store

__all__ = [
    "cash_flow_projection",
    "profitability_by_segment",
    "ltv_cac_ratio",
    "revenue_run_rate",
    "financial_health_indicators",
]

_HORIZONS = (30, 60, 90)


def cash_flow_projection(store: Store, as_of: Day, days: int = 90) -> DataFrame:
    """Confirmed renewals, projected new sales and revenue at risk for 30/60/90 days.

    Sales are projected from the mean of the days that had sales. Revenue is at
    risk when its customer had a failed payment in the last 60 days, however
    long ago the subscription expired. Subscriptions are totalled per customer
    first, so both subscription rows come from one pass.
    """
    today = required_day(as_of)
    names = [f"next_{n}_days" for n in _HORIZONS]
    until = shift_days(today, non_negative("days", days))

    expires, amount = F.col("expiration"), F.col("recurring_amount")
    confirmed = (expires >= at(today)) & (expires <= at(until))
    due = [expires <= at(shift_days(today, n)) for n in _HORIZONS]
    nothing = F.lit(0).cast("decimal(18,2)")
    per_customer = (
        store.subscriptions.filter(F.col("status") == fv.ACTIVE)
        .groupBy("customer_id")
        .agg(
            *(
                F.sum(F.when(confirmed, F.when(soon, amount).otherwise(nothing))).alias(f"confirmed_{n}")
                for n, soon in zip(_HORIZONS, due)
            ),
            *(F.sum(F.when(soon, amount).otherwise(nothing)).alias(f"due_{n}") for n, soon in zip(_HORIZONS, due)),
        )
    )
    failing = (
        store.orders.filter(
            (F.col("status") == fv.FAILED) & (F.col("date_created") >= at(shift_days(today, -60)))
        )
        .filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id").agg(rows("failures"))
    )
    failed = F.col("failures").isNotNull()
    totals = per_customer.join(failing, "customer_id", "left").agg(
        *(F.sum(f"confirmed_{n}").alias(f"confirmed_{n}") for n in _HORIZONS),
        *(F.sum(F.when(failed, F.col(f"due_{n}")).otherwise(nothing)).alias(f"risk_{n}") for n in _HORIZONS),
    )

    # Only the last 90 days of sales are read: older days take no part in any mean.
    sales = (
        paid_orders(store, shift_days(today, -90))
        .filter(F.col("type") == fv.SALE)
        .groupBy(F.to_date("date_created").alias("day"))
        .agg(money_sum("total").alias("revenue"))
    )

    def projected(n: int):
        recent = F.when(F.col("day") >= F.lit(shift_days(today, -n)), F.col("revenue"))
        return rounded_ratio(F.sum(recent), F.count(recent), factor=n).alias(f"sales_{n}")

    combined = totals.crossJoin(F.broadcast(sales.agg(*map(projected, _HORIZONS))))
    lines = (("Confirmed Revenue", "confirmed"), ("Projected New Sales", "sales"), ("At-Risk Revenue", "risk"))
    return combined.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(category).alias("category"),
                        *(
                            F.col(f"{prefix}_{n}").cast("double").alias(name)
                            for n, name in zip(_HORIZONS, names)
                        ),
                    )
                    for category, prefix in lines
                )
            )
        )
    )


def profitability_by_segment(store: Store, as_of: Day, start: Day = None, end: Day = None) -> DataFrame:
    """Revenue, cost and margin by product type and by customer loyalty.

    Product types look at the bundle attribute only. Costs are text: the leading
    number counts, anything else is 0. Repeated attribute rows repeat the sale;
    as everywhere this is a weight, applied to per-product totals. Customers
    have no cost; their class counts all paid orders ever, their revenue the
    range. Sales without a customer are "One-Time".
    """
    costs = meta_rows(store, fv.META_COST).groupBy(F.col("post_id").alias("product_id")).agg(
        rows("cost_rows"), F.sum(F.coalesce(leading_number(F.col("meta_value")), F.lit(0.0))).alias("unit_cost")
    )
    dims = bundle_marks(store).join(costs, "product_id", "left")
    sold = (
        sold_items(store, start, end)
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("units"), money_sum("item_total").alias("earned"))
        .join(dims, "product_id", "left")
    )
    revenue = F.sum(F.col("weight") * F.coalesce("cost_rows", F.lit(1)) * F.col("earned"))
    cost = F.sum(F.col("weight") * F.col("units") * F.coalesce("unit_cost", F.lit(0.0)))
    by_product = (
        split_by_type(sold, child_is_bundle=False)
        .groupBy(F.col("product_type").alias("segment_name"))
        .agg(revenue.cast("double").alias("revenue"), cost.alias("cost"))
        .select(
            F.lit("By Product Type").alias("segment_type"),
            "segment_name",
            "revenue",
            rounded(F.col("cost")).alias("estimated_cost"),
            rounded(F.col("revenue") - F.col("cost")).alias("gross_profit"),
            rounded(100.0 * ratio(F.col("revenue") - F.col("cost"), F.col("revenue"))).alias("profit_margin"),
        )
    )

    listed = is_within(F.col("date_created"), start, end)
    orders = F.col("orders")
    loyalty = first_match(
        (
            (F.col("customer_id").isNull(), "One-Time"),
            (orders >= 5, "Loyal"),
            (orders >= 2, "Repeat"),
        ),
        "One-Time",
    )
    by_customer = (
        paid_orders(store)
        .groupBy("customer_id")
        .agg(
            rows("orders"),
            count_if(listed).alias("listed"),
            money_sum("total", listed).alias("earned"),
        )
        .filter(F.col("listed") > 0)
        .groupBy(loyalty.alias("segment_name"))
        .agg(F.sum("earned").cast("double").alias("revenue"))
        .select(
            F.lit("By Customer Segment").alias("segment_type"),
            "segment_name",
            "revenue",
            F.lit(0.0).alias("estimated_cost"),
            F.col("revenue").alias("gross_profit"),
            F.lit(100.0).alias("profit_margin"),
        )
    )
    return by_product.unionByName(by_customer).orderBy("segment_type", F.desc("revenue"), "segment_name")


def ltv_cac_ratio(store: Store, as_of: Day) -> DataFrame:
    """Mean lifetime value against last year's revenue per new customer.

    Lifetime value covers customers with an order of any status. The cost
    figure is the proxy the report has always used, and is not rounded.
    """
    since = shift_months(required_day(as_of), -12)
    spent = (
        store.orders.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(sum_if(is_paid(), "total").alias("spent"))
    )
    ltv = spent.join(
        store.customers.select(F.col("id").alias("customer_id")), "customer_id", "left_semi"
    ).agg(F.sum("spent").alias("spent"), rows("customer_count"))
    revenue = paid_orders(store, since).agg(money_sum("total").alias("year_revenue"))
    fresh = within(store.customers, "date_created", since, None).agg(rows("new_customers"))
    mean = ratio(F.col("spent"), F.col("customer_count"))
    cac = ratio(F.col("year_revenue"), F.col("new_customers"))
    return (
        ltv.crossJoin(F.broadcast(revenue))
        .crossJoin(F.broadcast(fresh))
        .select(
            rounded(mean).alias("avg_ltv"),
            rounded(ratio(mean, cac)).alias("ltv_cac_ratio"),
            cac.alias("estimated_cac"),
            "customer_count",
        )
    )


def revenue_run_rate(store: Store, as_of: Day) -> DataFrame:
    """Run rates from the last month, the last three months and the subscriptions.

    Only three months of orders are read. A shop that never had a paid order gets
    NULL instead of 0. Older orders are asked about that only where the three months
    have none: they are joined to a broadcast that is empty otherwise, and then
    adaptive execution drops the join before it starts a task.
    """
    today = required_day(as_of)
    one, three = at(shift_months(today, -1)), at(shift_months(today, -3))
    created = F.col("date_created")
    recent = paid_orders(store, shift_months(today, -3)).agg(
        sum_if(created >= one, "total").alias("month"), money_sum("total").alias("quarter"), rows("lately")
    )
    doubtful = recent.filter((F.col("lately") == 0) & all_read("month", "quarter")).select("lately")
    older = paid_orders(store).filter((created < three) | created.isNull()).select("id")
    ever = older.crossJoin(F.broadcast(doubtful)).limit(1).agg(rows("ever"))
    subs = store.subscriptions.filter(F.col("status") == fv.ACTIVE).agg(
        money_sum("recurring_amount").alias("mrr_from_subscriptions")
    )

    def known(amount):
        return F.when(F.col("ever") + F.col("lately") > 0, F.coalesce(amount.cast("double"), F.lit(0.0)))

    month, quarter = known(F.col("month")), known(F.col("quarter"))
    return (
        recent.crossJoin(F.broadcast(ever))
        .crossJoin(F.broadcast(subs))
        .select(
            month.alias("last_month_revenue"),
            rounded(month * 12).alias("annual_run_rate"),
            rounded(quarter / 3).alias("avg_monthly_revenue_3mo"),
            rounded(quarter / 3 * 12).alias("annual_run_rate_3mo"),
            (F.col("mrr_from_subscriptions") * 12).alias("arr_from_subscriptions"),
            "mrr_from_subscriptions",
        )
    )


def financial_health_indicators(store: Store, as_of: Day) -> DataFrame:
    """Growth, churn, retention and refund rate, each graded; unknown is Poor.

    Two months of orders give growth and refunds, one pass over subscriptions
    gives churn, and one flag pair per customer gives retention.
    """
    today = required_day(as_of)
    one = at(shift_months(today, -1))
    created, status = F.col("date_created"), F.col("status")
    paid, recent = is_paid(), created >= one

    orders = within(store.orders, "date_created", shift_months(today, -2), None).filter(paid | (status == fv.REFUNDED)).agg(
        money_sum("total", paid & recent).alias("this_month"),
        money_sum("total", paid & ~recent).alias("month_before"),
        count_if(recent & (status == fv.REFUNDED)).alias("refunds"),
        count_if(recent).alias("settled"),
    )
    buyers = (
        paid_orders(store)
        .filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.bool_or(created < one).alias("before"), F.bool_or(recent).alias("lately"))
        .agg(count_if(F.col("before")).alias("old_buyers"), count_if(F.col("before") & F.col("lately")).alias("kept"))
    )
    subs = store.subscriptions.agg(
        count_if(status.isin(*fv.ENDED_STATUSES) & (F.col("expiration") >= one)).alias("ended"),
        count_if(F.col("created") < one).alias("older_subs"),
    )

    names = ("Excellent", "Good", "Fair")
    indicators = (
        ("Revenue Growth", percent_change(F.col("this_month"), F.col("month_before")), (10, 5, 0), True),
        ("Churn Rate", percent(F.col("ended"), F.col("older_subs")), (3, 5, 7), False),
        ("Customer Retention", percent(F.col("kept"), F.col("old_buyers")), (80, 70, 60), True),
        ("Refund Rate", percent(F.col("refunds"), F.col("settled")), (2, 5, 8), False),
    )
    return (
        orders.crossJoin(F.broadcast(buyers))
        .crossJoin(F.broadcast(subs))
        .select(
            F.inline(
                F.array(
                    *(
                        F.struct(
                            F.lit(metric).alias("metric"),
                            value.alias("value"),
                            F.lit("%").alias("unit"),
                            graded(value, zip(cuts, names), "Poor", rising).alias("health_status"),
                        )
                        for metric, value, cuts, rising in indicators
                    )
                )
            )
        )
    )
