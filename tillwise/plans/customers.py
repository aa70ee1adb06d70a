"""Per-customer sub-plans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import fixed_values as fv
from tillwise.functions.dates import Day, at, within
from tillwise.functions.labels import is_paid
from tillwise.plans.sales import count_if, rows, sum_if
from tillwise.sources.store import Store


def signups(store: Store, start: Day = None, end: Day = None) -> DataFrame:
    """Customers with a known signup date, in range."""
    known = store.customers.filter(F.col("date_created").isNotNull())
    return within(known, "date_created", start, end)


def order_history(orders: DataFrame, *more: Column) -> DataFrame:
    """One row per customer: orders, paid total, last order, and more aggregates.

    Aggregating before the join to customers collapses busy customers on the
    map side and makes the join one-to-one. Orders without a customer are
    dropped first.
    """
    return (
        orders.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            rows("orders"),
            sum_if(is_paid(), "total").alias("spent"),
            F.max("date_created").alias("last_order"),
            *more,
        )
    )


def known_customers(store: Store, per_customer: DataFrame) -> DataFrame:
    """Join per-customer rows to the customer table, adding e-mail and name."""
    people = store.customers.select(F.col("id").alias("customer_id"), "email", "name")
    return people.join(per_customer, "customer_id")


def spend_of_everyone(store: Store) -> DataFrame:
    """``customer_id, spent`` for every customer, 0 for those who never paid."""
    paid = order_history(store.orders.filter(is_paid())).select("customer_id", "spent")
    everyone = store.customers.select(F.col("id").alias("customer_id"))
    spent = F.coalesce("spent", F.lit(0).cast("decimal(28,2)")).alias("spent")
    return everyone.join(paid, "customer_id", "left").select("customer_id", spent)


def subscription_counts(store: Store, ended_since: dt.date) -> DataFrame:
    """Per customer: active subscriptions, and those ended since a day (or ending later)."""
    ended = F.col("status").isin(*fv.ENDED_STATUSES) & (F.col("expiration") >= at(ended_since))
    active = F.col("status") == fv.ACTIVE
    return (
        store.subscriptions.filter(F.col("customer_id").isNotNull() & (active | ended))
        .groupBy("customer_id")
        .agg(count_if(active).alias("active"), count_if(ended).alias("ended"))
    )
