"""Recurring revenue, renewals, licences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions import fixed_values as fv
from tillwise.functions.dates import (
    Day,
    at,
    by_month_series,
    first_of_month,
    month_label,
    month_of,
    non_negative,
    parse_day,
    required_day,
    shift_days,
    shift_months,
    within,
    within_months,
)
from tillwise.functions.labels import is_paid
from tillwise.functions.numbers import money_sum, percent, rounded, rounded_ratio
from tillwise.plans.sales import head, rows, totals_apart, zero
from tillwise.sources.store import Store

__all__ = [
    "mrr_by_month",
    "current_mrr_breakdown",
    "renewal_rates_by_month",
    "upcoming_renewals",
    "top_licenses",
]


def mrr_by_month(store: Store, as_of: Day, start: Day = None, end: Day = None) -> DataFrame:
    """Monthly recurring revenue by subscription start, refunded ones left out.

    A subscription is refunded when its first payment is a refunded order, or
    the parent of one. Both kinds of key go into one list, so the exclusion is
    a plain hash anti-join; the many subscriptions without a first payment (or with
    the same one) can be split in it. Every amount counts as yearly.
    """
    subs = within(
        store.subscriptions.filter(F.col("status") != fv.PENDING), "created", start, end
    )
    refunded = totals_apart(
        store.orders.filter(F.col("status") == fv.REFUNDED)
        .select(F.explode(F.array("id", "parent")).alias("parent_payment_id"))
        .filter(F.col("parent_payment_id").isNotNull()),
        ["parent_payment_id"],
    )
    monthly = (
        subs.join(refunded, "parent_payment_id", "left_anti")
        .groupBy(month_of("created").alias("month"))
        .agg(
            rows("subscriptions"),
            rounded_ratio(money_sum("initial_amount"), F.lit(12)).alias("mrr"),
        )
    )
    return by_month_series(monthly, "subscriptions", "mrr")


def current_mrr_breakdown(store: Store, as_of: Day) -> DataFrame:
    """New, existing, churned and net recurring revenue of the current month, in one pass."""
    month = first_of_month(required_day(as_of))
    begin, end = at(month), at(shift_months(month, 1))
    status, created, expires = F.col("status"), F.col("created"), F.col("expiration")

    def monthly(condition):
        total = rounded_ratio(money_sum("initial_amount", condition), F.lit(12))
        return F.coalesce(total, F.lit(0.0))

    return (
        store.subscriptions.agg(
            monthly((created >= begin) & (created < end) & (status != fv.PENDING)).alias("new_mrr"),
            monthly((created < begin) & (status == fv.ACTIVE)).alias("existing_mrr"),
            monthly(
                (expires >= begin) & (expires < end) & status.isin(*fv.ENDED_STATUSES)
            ).alias("churned_mrr"),
        )
        .withColumn("net_mrr", rounded(F.col("new_mrr") + F.col("existing_mrr") - F.col("churned_mrr")))
    )


def renewal_rates_by_month(
    store: Store,
    as_of: Day,
    start: Day = None,
    end: Day = None,
    cohort_first_day: Day = None,
) -> DataFrame:
    """Share of a signup month's customers who paid again in the 13th month.

    The range selects whole renewal months (signup + 12 months). Lifetime deals
    (a single purchase of high value) leave the cohort. Orders are joined to
    their one customer, so a busy customer's orders can be split over tasks.
    ``cohort_first_day`` leaves out earlier signups, where their data can't be
    trusted (2015-01-01 in the original reports); None takes all.
    """
    months = fv.RENEWAL_MONTHS
    latest = shift_months(required_day(as_of), -months)
    lifetime_deal = (F.col("purchase_count") == 1) & (F.col("purchase_value") >= fv.LIFETIME_DEAL_VALUE)
    cohort = within(store.customers, "date_created", cohort_first_day, latest).filter(~lifetime_deal)
    cohort = within_months(cohort, "date_created", start, end, shift=months)
    opens = F.col("signup") + F.expr(f"INTERVAL '{months}' MONTH")
    closes = F.col("signup") + F.expr(f"INTERVAL '{months + 1}' MONTH")
    cohort = cohort.select(F.col("id").alias("customer_id"), F.col("date_created").alias("signup"))
    cohort = cohort.withColumns({"opens": opens, "closes": closes, "month": month_of(opens)})

    # No renewal window lies outside these days; the bounds reach the scan.
    first = parse_day(cohort_first_day) and shift_months(parse_day(cohort_first_day), months)
    last = shift_days(shift_months(latest, months + 1), 2)
    if parse_day(start):
        first = max(first or first_of_month(parse_day(start)), first_of_month(parse_day(start)))
    if parse_day(end):
        last = min(last, shift_months(first_of_month(parse_day(end)), 2))
    renewals = store.orders.filter(
        is_paid() & (F.col("date_created") >= at(first) if first else F.lit(True)) & (F.col("date_created") < at(last))
    ).select("customer_id", "date_created")
    renewed = (
        renewals.join(cohort, "customer_id")
        .filter((F.col("date_created") >= F.col("opens")) & (F.col("date_created") < F.col("closes")))
        .groupBy("month", "customer_id").agg(rows())
        .groupBy("month").agg(rows("renewed"))
    )
    return (
        cohort.groupBy("month").agg(rows("customers"))
        .join(renewed, "month", "left")
        .select(
            F.date_format("month", "yyyy-MM").alias("month_year"),
            month_label("month").alias("label"),
            percent(zero("renewed"), F.col("customers")).alias("renewal_rate"),
        )
        .orderBy("month_year")
    )


def upcoming_renewals(store: Store, as_of: Day, days: int = 30) -> DataFrame:
    """Active subscriptions expiring within the next ``days``: ``count, estimated_revenue``."""
    today = required_day(as_of)
    until = shift_days(today, non_negative("days", days))
    due = within(store.subscriptions.filter(F.col("status") == fv.ACTIVE), "expiration", today, until)
    return due.agg(
        rows("count"),
        F.coalesce(money_sum("recurring_amount"), F.lit(0).cast("decimal(28,2)")).alias("estimated_revenue"),
    )


def top_licenses(store: Store, as_of: Day, limit: int | None = 20) -> DataFrame:
    """Licences with the most activations; empty without the licensing tables."""
    activations = (
        store.license_activations.groupBy(F.col("license_id")).agg(F.count("site_name").alias("used"))
    )
    top = (
        store.licenses.filter(F.col("status") != fv.DISABLED)
        .withColumnRenamed("id", "license_id")
        .join(activations, "license_id", "left")
        .select("license_id", "license_key", zero("used").alias("activation_count"), "download_id")
        .transform(head, limit, "-activation_count", "license_id")
    )
    titles = store.products.select(
        F.col("id").alias("download_id"), F.col("post_title").alias("download_name")
    )
    return (
        top.join(titles, "download_id", "left")
        .select("license_id", "license_key", "activation_count", "download_name")
        .orderBy(F.desc("activation_count"), "license_id")
    )
