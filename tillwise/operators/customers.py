"""Lifetime value, segments, health, journey, geography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import fixed_values as fv
from tillwise.functions.dates import (
    Day,
    month_date,
    month_label,
    month_of,
    required_day,
    shift_days,
)
from tillwise.functions.labels import (
    FIRST_PURCHASE_ORDER,
    channel_of,
    first_match,
    first_purchase_class,
    frequency_score,
    is_paid,
    monetary_score,
    position,
    recency_score,
    rfm_segment,
)
from tillwise.functions.numbers import cents_of, money_of, money_sum, percent, rounded_ratio
from tillwise.plans.customers import (
    known_customers,
    order_history,
    signups,
    spend_of_everyone,
    subscription_counts,
)
from tillwise.plans.prefix import value_counts, value_ranks
from tillwise.plans.sales import count_if, head, paid_orders, rows, sum_if, totals_apart, with_billing_places, zero
from tillwise.sources.store import Store

__all__ = [
    "customer_lifetime_values",
    "clv_by_cohort",
    "clv_distribution",
    "rfm_segments",
    "segment_performance",
    "customer_health_scores",
    "at_risk_customers",
    "customer_acquisition_channels",
    "time_to_first_purchase",
    "customer_activation_funnel",
    "customers_by_country",
]


def _days_since(day: Day, column: str) -> Column:
    return F.datediff(F.lit(required_day(day)), F.col(column))


def customer_lifetime_values(
    store: Store, as_of: Day, start: Day = None, end: Day = None, limit: int | None = 100
) -> DataFrame:
    """Top customers by paid revenue; order count and last order cover every status."""
    paid_total = F.when(is_paid(), F.col("total"))
    history = order_history(
        store.orders, rounded_ratio(money_sum("total", is_paid()), F.count(paid_total)).alias("avg_order_value")
    )
    people = signups(store, start, end).withColumnRenamed("id", "customer_id")
    return (
        people.join(history, "customer_id")
        .select(
            "customer_id",
            "email",
            "name",
            F.col("date_created").alias("signup_date"),
            F.col("orders").alias("purchase_count"),
            F.col("spent").alias("total_spent"),
            "avg_order_value",
            _days_since(as_of, "date_created").alias("days_active"),
            F.col("last_order").alias("last_purchase_date"),
        )
        .transform(head, limit, "-total_spent", "customer_id")
    )


def clv_by_cohort(store: Store, as_of: Day, start: Day = None, end: Day = None) -> DataFrame:
    """Mean revenue, orders and age per signup month, customers without orders included."""
    people = signups(store, start, end).select(F.col("id").alias("customer_id"), "date_created")
    return (
        people.join(order_history(store.orders), "customer_id", "left")
        .groupBy(month_of("date_created").alias("month"))
        .agg(
            rows("customer_count"),
            rounded_ratio(F.sum("spent"), F.count(F.lit(1))).alias("clv"),
            rounded_ratio(F.sum("orders"), F.count(F.lit(1))).alias("purchases"),
            rounded_ratio(F.sum(_days_since(as_of, "date_created")), F.count(F.lit(1)), 0).alias("avg_days_active"),
        )
        .select(
            month_date("month").alias("cohort_date"),
            month_label("month").alias("cohort_label"),
            "customer_count",
            F.coalesce("clv", F.lit(0.0)).alias("avg_clv"),
            F.coalesce("purchases", F.lit(0.0)).alias("avg_purchases"),
            "avg_days_active",
        )
        .orderBy("cohort_date")
    )


def clv_distribution(store: Store, as_of: Day) -> DataFrame:
    """Spenders by class of spend.

    A class opens at the spend found at 0-based rank ``floor(N * q)`` among all
    ``N`` customers, zero spenders included; only spenders are then counted.
    Everything after the per-customer sum works on distinct spend values.
    """
    counts = value_counts(spend_of_everyone(store), "spent")
    ranks = value_ranks(counts, "spent")
    size = store.customers.agg(rows("size"))
    rank_of = {
        label: F.floor(F.col("size") * F.lit(f"{q:.2f}").cast("decimal(3,2)")).cast("long")
        for q, label in fv.SPEND_CLASSES
    }
    holds = {
        label: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
        for label, k in rank_of.items()
    }
    cuts = ranks.crossJoin(F.broadcast(size)).agg(
        *(F.max(F.when(hit, F.col("spent"))).alias(label) for label, hit in holds.items())
    )
    labels = [label for _, label in fv.SPEND_CLASSES]
    segment = first_match(
        ((F.col("spent") >= F.col(f"`{label}`"), label) for label in labels), fv.SPEND_CLASS_REST
    )
    # Non-spenders drop out of the sums, not by a filter: a filter would be pushed
    # into this use of the counts only and have them computed twice.
    spenders = F.when(F.col("spent") > 0, F.col("n"))
    revenue = F.sum(spenders * F.col("spent"))
    return (
        counts.crossJoin(F.broadcast(cuts))
        .groupBy(segment.alias("segment"))
        .agg(
            F.sum(spenders).alias("customer_count"),
            rounded_ratio(revenue, F.sum(spenders)).alias("avg_clv"),
            revenue.alias("total_revenue"),
        )
        .filter(F.col("customer_count") > 0)
        .orderBy(position(F.col("segment"), (*labels, fv.SPEND_CLASS_REST)))
    )


def _rfm(store: Store, as_of: Day) -> DataFrame:
    history = order_history(paid_orders(store))
    recency = _days_since(as_of, "last_order")
    return known_customers(store, history).select(
        "customer_id",
        "email",
        "name",
        recency.alias("recency_days"),
        F.col("orders").alias("frequency"),
        F.col("spent").alias("monetary"),
        recency_score(recency).alias("recency_score"),
        frequency_score(F.col("orders")).alias("frequency_score"),
        monetary_score(F.col("spent")).alias("monetary_score"),
    )


def rfm_segments(store: Store, as_of: Day) -> DataFrame:
    """Recency, frequency and monetary scores of every paying customer, best first."""
    return _rfm(store, as_of).orderBy(
        F.desc("recency_score"), F.desc("frequency_score"), F.desc("monetary_score"), "customer_id"
    )


def segment_performance(store: Store, as_of: Day) -> DataFrame:
    """Customers and revenue per segment of the three scores."""
    segment = rfm_segment(F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score"))
    people = F.count(F.lit(1))
    return (
        _rfm(store, as_of)
        .groupBy(segment.alias("segment"))
        .agg(
            rows("customer_count"),
            F.sum("monetary").alias("total_revenue"),
            rounded_ratio(F.sum("monetary"), people).alias("avg_revenue"),
            rounded_ratio(F.sum("frequency"), people).alias("avg_purchases"),
            rounded_ratio(F.sum("recency_days"), people, 0).alias("avg_days_since_purchase"),
        )
        .orderBy(F.desc("total_revenue"), "segment")
    )


def _with_subscriptions(store: Store, history: DataFrame, ended_since: Day) -> DataFrame:
    """Customer rows with ``active`` and ``ended`` subscription counts (0 for none)."""
    counts = subscription_counts(store, ended_since)
    joined = known_customers(store, history).join(counts, "customer_id", "left")
    return joined.withColumns({"active": zero("active"), "ended": zero("ended")})


def customer_health_scores(store: Store, as_of: Day, limit: int | None = 100) -> DataFrame:
    """Healthiest paying customers: recency, orders, active subscriptions."""
    today = required_day(as_of)
    people = _with_subscriptions(store, order_history(paid_orders(store)), today)
    days = F.col("days_since_purchase")
    grades = (
        ((days <= 30) & (F.col("active") > 0), "Excellent", 95),
        ((days <= 60) & (F.col("orders") >= 2), "Good", 75),
        (days <= 90, "Fair", 50),
        (days <= 180, "At Risk", 25),
    )
    return (
        people.withColumn("days_since_purchase", _days_since(today, "last_order"))
        .select(
            "customer_id",
            "email",
            "name",
            "days_since_purchase",
            F.col("orders").alias("total_purchases"),
            F.col("spent").alias("total_spent"),
            F.col("active").alias("active_subscriptions"),
            first_match(((rule, status) for rule, status, _ in grades), "Poor").alias("health_status"),
            first_match(((rule, score) for rule, _, score in grades), 10).alias("health_score"),
        )
        .transform(head, limit, "-health_score", "-total_spent", "customer_id")
    )


def at_risk_customers(store: Store, as_of: Day, limit: int | None = 50) -> DataFrame:
    """Repeat customers gone quiet, and customers with recently ended subscriptions.

    "Recently" has no upper bound: subscriptions ended early with a later
    expiration date count as well.
    """
    today = required_day(as_of)
    history = order_history(paid_orders(store))
    days, orders, ended = F.col("days_since_purchase"), F.col("orders"), F.col("ended")
    risk = first_match(((ended > 0, "High"), ((days > 120) & (orders >= 3), "Medium")), "Low")
    return (
        _with_subscriptions(store, history, shift_days(today, -90))
        .withColumn("days_since_purchase", _days_since(today, "last_order"))
        .filter(((days > 90) & (orders >= 2)) | (ended > 0))
        .select(
            "customer_id",
            "email",
            "name",
            "days_since_purchase",
            orders.alias("total_purchases"),
            F.col("spent").alias("total_spent"),
            F.col("last_order").alias("last_purchase_date"),
            ended.alias("recent_cancellations"),
            risk.alias("churn_risk"),
        )
        .transform(head, limit, position(F.col("churn_risk"), ("High", "Medium", "Low")), "-total_spent", "customer_id")
    )


def customer_acquisition_channels(
    store: Store, as_of: Day, start: Day = None, end: Day = None, dedupe: bool = False
) -> DataFrame:
    """Customers and revenue per channel named in their payment notes.

    A customer counts in every channel found in the notes; e-mail addresses are
    compared without regard to case. The original report also joins attribute
    and e-mail rows it does not use, which repeats each customer: sums and
    averages are therefore weighted by (attributes x addresses x notes). The
    weight is computed from counts, the repeated rows are never built.
    ``dedupe=True`` drops the weight: one row per customer and channel.
    """
    notes = totals_apart(
        store.notes.filter(F.col("comment_type") == fv.PAYMENT_NOTE).select(
            F.lower("comment_author_email").alias("mail"), channel_of(F.col("content")).alias("channel")
        ),
        ["mail", "channel"],
        rows("notes"),
    )
    spent = (
        store.orders.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(sum_if(is_paid(), "total").alias("spent"))
    )

    def copies(table: str) -> DataFrame:
        return store.table(table).groupBy("customer_id").agg(rows(table))

    people = (
        signups(store, start, end)
        .select(F.col("id").alias("customer_id"), F.lower("email").alias("mail"))
        .join(spent, "customer_id", "left")
    )
    weight = F.lit(1).cast("long")
    if not dedupe:
        for table in ("customermeta", "customer_email_addresses"):
            people = people.join(copies(table), "customer_id", "left")
            weight = weight * F.coalesce(table, F.lit(1))
        weight = weight * F.coalesce("notes", F.lit(1))
    revenue = F.sum(weight * F.col("spent"))
    return (
        people.join(notes, "mail", "left")
        .groupBy(F.coalesce("channel", F.lit(fv.CHANNEL_OTHER)).alias("channel"))
        .agg(
            rows("customer_count"),
            revenue.alias("total_revenue"),
            rounded_ratio(revenue, F.sum(F.when(F.col("spent").isNotNull(), weight))).alias(
                "avg_revenue_per_customer"
            ),
        )
        .orderBy(F.desc("customer_count"), "channel")
    )


def time_to_first_purchase(store: Store, as_of: Day, start: Day = None, end: Day = None) -> DataFrame:
    """Days from signup to the first paid order, in classes."""
    first_order = (
        paid_orders(store)
        .filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.min("date_created").alias("first_order"))
    )
    people = signups(store, start, end).select(F.col("id").alias("customer_id"), "date_created")
    return (
        people.join(first_order, "customer_id")
        .withColumn("days", F.datediff("first_order", "date_created"))
        .groupBy(first_purchase_class(F.col("days")).alias("time_segment"))
        .agg(
            rows("customer_count"),
            rounded_ratio(F.sum("days"), F.count("days"), 1).alias("avg_days"),
        )
        .orderBy(position(F.col("time_segment"), FIRST_PURCHASE_ORDER))
    )


def customer_activation_funnel(
    store: Store, as_of: Day, start: Day = None, end: Day = None
) -> DataFrame:
    """Signups, purchasers, repeat purchasers and subscribers, with rates."""
    orders = (
        paid_orders(store)
        .filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(rows("orders"))
    )
    subscribers = (
        store.subscriptions.filter((F.col("status") != fv.PENDING) & F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(rows("subs"))
    )
    people = signups(store, start, end).select(F.col("id").alias("customer_id"))
    return (
        people.join(orders, "customer_id", "left")
        .join(subscribers, "customer_id", "left")
        .agg(
            rows("total_signups"),
            F.count("orders").alias("made_purchase"),
            count_if(F.col("orders") >= 2).alias("repeat_purchase"),
            F.count("subs").alias("became_subscriber"),
        )
        .withColumns(
            {
                "purchase_rate": percent(F.col("made_purchase"), F.col("total_signups")),
                "repeat_rate": percent(F.col("repeat_purchase"), F.col("made_purchase")),
                "subscription_rate": percent(F.col("became_subscriber"), F.col("made_purchase")),
            }
        )
    )


def customers_by_country(
    store: Store, as_of: Day, start: Day = None, end: Day = None, limit: int | None = 20
) -> DataFrame:
    """Customers, orders and paid revenue per billing country.

    Customers without orders, orders without billing address and addresses
    without country are all "Unknown". An order with several billing addresses
    repeats in the revenue. Addresses are placed once, by order; orders are totalled
    per customer and country before they meet the customer table.
    """
    orders = store.orders.filter(F.col("customer_id").isNotNull()).select(
        F.col("id").alias("order_id"),
        "customer_id",
        F.when(is_paid(), cents_of("total")).otherwise(0).alias("cents"),
    )
    per_customer = (
        with_billing_places(orders, store, F.coalesce("country", F.lit("Unknown")))
        .groupBy("customer_id", F.coalesce("place", F.lit("Unknown")).alias("country"))
        .agg(rows("orders"), F.sum(F.col("cents") * F.col("copies")).alias("cents"))
    )
    people = signups(store, start, end).select(F.col("id").alias("customer_id"))
    return (
        people.join(per_customer, "customer_id", "left")
        .groupBy(F.coalesce("country", F.lit("Unknown")).alias("country"))
        .agg(
            rows("customer_count"),
            zero(F.sum("orders")).alias("total_orders"),
            money_of(zero(F.sum("cents")), 38).alias("total_revenue"),
        )
        .transform(head, limit, "-customer_count", "country")
    )
