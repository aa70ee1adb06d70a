"""Churn scores, forecasts, seasonality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions import fixed_values as fv
from tillwise.functions.dates import (
    Day,
    at,
    first_of_month,
    month_of,
    non_negative,
    required_day,
    shift_days,
    shift_months,
)
from tillwise.functions.labels import first_match, graded, is_paid
from tillwise.functions.numbers import money_of, money_sum, percent_change, ratio, rounded, rounded_ratio
from tillwise.plans.customers import known_customers, order_history, subscription_counts
from tillwise.plans.sales import count_if, monthly_customer_sales, paid_orders, rows, sold_items, head, with_titles, zero
from tillwise.sources.store import Store

__all__ = [
    "churn_prediction_scores",
    "revenue_forecast",
    "demand_forecast",
    "seasonal_patterns",
]

def churn_prediction_scores(store: Store, as_of: Day, limit: int | None = 100) -> DataFrame:
    """Customers by churn risk; failed orders count for recency and order number."""
    today = required_day(as_of)
    since = shift_months(today, -3)
    failed = F.col("status") == fv.FAILED
    history = order_history(
        store.orders.filter(is_paid() | failed),
        count_if(failed & (F.col("date_created") >= at(since))).alias("failures"),
    )
    days, failures = F.col("days_since_last_order"), F.col("recent_failed_payments")
    levels = (
        ((days > 180) | (failures >= 2) | (F.col("ended") > 0), "High", 85),
        ((days > 90) | (failures >= 1), "Medium", 55),
    )
    return (
        known_customers(store, history)
        .join(subscription_counts(store, since), "customer_id", "left")
        .select(
            "customer_id",
            "email",
            "name",
            F.datediff(F.lit(today), "last_order").alias("days_since_last_order"),
            F.col("orders").alias("total_orders"),
            F.col("spent").alias("lifetime_value"),
            zero("active").alias("active_subscriptions"),
            F.col("failures").alias("recent_failed_payments"),
            zero("ended").alias("ended"),
        )
        .withColumn("churn_risk", first_match(((rule, risk) for rule, risk, _ in levels), "Low"))
        .withColumn("churn_score", first_match(((rule, score) for rule, _, score in levels), 20))
        .drop("ended")
        .transform(head, limit, "-churn_score", "-lifetime_value", "customer_id")
    )


def revenue_forecast(store: Store, as_of: Day, months: int = 6) -> DataFrame:
    """Revenue projected from the mean and spread of the last year's monthly growth.

    The same value for every month of the horizon (no compounding). Growth steps over absent months; the spread is the population
    standard deviation.
    """
    today = required_day(as_of)
    horizon = non_negative("months", months)
    monthly = (
        paid_orders(store, shift_months(today, -12))
        .groupBy(month_of("date_created").alias("month"))
        .agg(money_sum("total").alias("revenue"))
    )
    previous = F.lag("revenue").over(Window.orderBy("month"))
    growth = 100.0 * ratio(F.col("revenue") - previous, previous)
    stats = (
        monthly.withColumn("growth", growth)
        .agg(
            ratio(F.sum("revenue"), F.count("revenue")).alias("mean"),
            F.avg("growth").alias("growth_rate"),
            F.stddev_pop("growth").alias("spread"),
            rows("months"),
        )
        .filter(F.col("months") > 0)
    )

    def estimate(rate):
        return rounded(F.col("mean") * (1 + rate / 100))

    rate, spread = F.col("growth_rate"), F.col("spread")
    steps = [
        F.struct(
            F.lit(shift_months(first_of_month(today), n).isoformat()).alias("forecast_date"),
            F.lit(f"{shift_months(today, n):%B %Y}").alias("forecast_label"),
        )
        for n in range(1, horizon + 1)
    ]
    empty = F.array().cast("array<struct<forecast_date:string,forecast_label:string>>")
    return (
        stats.select("*", F.inline(F.array(*steps) if steps else empty))
        .select(
            "forecast_date",
            "forecast_label",
            estimate(rate).alias("projected_revenue"),
            estimate(rate - spread).alias("conservative_estimate"),
            estimate(rate + spread).alias("optimistic_estimate"),
            "growth_rate",
            graded(F.col("months"), ((12, "High"), (6, "Medium")), "Low").alias("confidence_level"),
        )
        .orderBy("forecast_date")
    )


def demand_forecast(store: Store, as_of: Day, days: int = 30, limit: int | None = 10) -> DataFrame:
    """Units and revenue expected from the last 90 days' best-selling products.

    Means are over days with sales. The trend compares the last 30 days with the
    30 before; a missing side is "Stable". Ranking and means come from the same
    daily totals.
    """
    today = required_day(as_of)
    ahead = non_negative("days", days)
    daily = (
        sold_items(store, shift_days(today, -90), None, "date_created")
        .groupBy("product_id", F.to_date("date_created").alias("day"))
        .agg(F.sum("quantity").alias("units"), money_sum("item_total").alias("revenue"))
    )
    latest = F.col("day") >= F.lit(shift_days(today, -30))
    earlier = (F.col("day") >= F.lit(shift_days(today, -60))) & ~latest

    def mean_units(condition):
        units = F.when(condition, F.col("units"))
        return ratio(F.sum(units), F.count(units))

    top = (
        daily.groupBy("product_id")
        .agg(
            F.sum("revenue").alias("total_revenue"),
            rows("data_points"),
            ratio(F.sum("units"), F.count("units")).alias("avg_daily_sales"),
            ratio(F.sum("revenue"), F.count("revenue")).alias("avg_daily_revenue"),
            mean_units(latest).alias("now"),
            mean_units(earlier).alias("then"),
        )
        .transform(head, limit, "-total_revenue", "product_id")
    )
    trend = first_match(
        ((F.col("now") > F.col("then"), "Increasing"), (F.col("now") < F.col("then"), "Decreasing")), "Stable"
    )
    return (
        with_titles(top, store)
        .select(
            "product_id",
            "product_name",
            rounded(F.col("avg_daily_sales") * ahead, 0).alias("forecasted_units"),
            rounded(F.col("avg_daily_revenue") * ahead).alias("forecasted_revenue"),
            "avg_daily_sales",
            "avg_daily_revenue",
            trend.alias("trend_direction"),
            graded(F.col("data_points"), ((90, "High"), (30, "Medium")), "Low").alias("forecast_confidence"),
        )
        .orderBy(F.desc("forecasted_revenue"), "product_id")
    )


def seasonal_patterns(store: Store, as_of: Day) -> DataFrame:
    """Calendar months of the last two years against the mean month.

    The overall mean is a window over the monthly rows, at most 25 of them.
    """
    since = shift_months(required_day(as_of), -24)
    everything = Window.partitionBy()
    monthly = (
        monthly_customer_sales(store, since)
        .groupBy("month")
        .agg(
            money_of(F.sum("cents")).cast("double").alias("revenue"),
            F.sum("orders").alias("orders"),
            F.count("customer_id").alias("customers"),
        )
        .withColumn("overall", F.avg("revenue").over(everything))
    )
    mean, overall = F.avg("revenue"), F.first("overall")
    seasons = ((1.2, "Peak Season"), (1.1, "High Season"), (0.9, "Normal Season"), (0.8, "Low Season"))
    return (
        monthly.groupBy(F.month("month").alias("month_number"), F.date_format("month", "MMMM").alias("month_name"))
        .agg(
            rounded(mean).alias("avg_revenue"),
            rounded_ratio(F.sum("orders"), F.count("orders"), 0).alias("avg_orders"),
            rounded_ratio(F.sum("customers"), F.count("customers"), 0).alias("avg_customers"),
            rounded(F.stddev_pop("revenue")).alias("revenue_volatility"),
            rounded(100.0 * ratio(mean - overall, overall)).alias("deviation_from_average"),
            first_match(((mean >= overall * F.lit(cut), name) for cut, name in seasons), "Off Season").alias(
                "seasonality_classification"
            ),
        )
        .orderBy("month_number")
    )
