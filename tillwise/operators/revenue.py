"""Customer growth, revenue, refunds, payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions import fixed_values as fv
from tillwise.functions.dates import (
    Day,
    at,
    by_month_series,
    is_within,
    month_label,
    month_of,
    required_day,
    within,
    within_months,
)
from tillwise.functions.labels import is_paid, region_of
from tillwise.functions.numbers import cents_of, money_of, money_sum, percent, percent_change, rounded_ratio
from tillwise.plans.customers import signups
from tillwise.plans.prefix import all_read, running_before, value_ranks
from tillwise.plans.sales import (
    count_if,
    monthly_customer_sales,
    paid_orders,
    rows,
    sold_items,
    sum_if,
    with_billing_places,
    zero,
)
from tillwise.sources.store import Store

__all__ = [
    "new_customers_by_month",
    "new_customers_yoy_change",
    "revenue_by_month",
    "refunded_revenue_by_month",
    "refund_rates_by_month",
    "new_customer_refund_rates_by_year",
    "customer_engagement_metrics",
    "revenue_by_region",
    "revenue_breakdown",
    "revenue_concentration",
    "average_revenue_per_customer",
    "payment_method_performance",
    "failed_payment_recovery",
    "revenue_velocity",
]

_HOUR = 3_600_000_000  # microseconds
_RECOVERY_WINDOW = 30 * 24 * _HOUR


def new_customers_by_month(store: Store, as_of: Day, start: Day = None, end: Day = None) -> DataFrame:
    """Signups per month: ``date, label, value``."""
    monthly = signups(store, start, end).groupBy(month_of("date_created").alias("month")).agg(rows("value"))
    return by_month_series(monthly, "value")


def new_customers_yoy_change(store: Store, as_of: Day) -> DataFrame:
    """Signups this year and last year, and the change in percent (0 without a last year)."""
    year = required_day(as_of).year
    january = {y: at(required_day(f"{y}-01-01")) for y in (year - 1, year, year + 1)}
    created = F.col("date_created")
    counts = store.customers.filter((created >= january[year - 1]) & (created < january[year + 1])).agg(
        count_if(created >= january[year]).alias("current_year"),
        count_if(created < january[year]).alias("last_year"),
    )
    change = percent_change(F.col("current_year"), F.col("last_year"))
    return counts.withColumn("change", F.coalesce(change, F.lit(0.0)))


def revenue_by_month(store: Store, as_of: Day, start: Day = None, end: Day = None) -> DataFrame:
    """Paid sales and renewals per month: ``new_revenue, recurring_revenue, total_revenue``."""
    kind = F.col("type")
    monthly = (
        paid_orders(store, start, end)
        .filter(kind.isin(fv.SALE, fv.RENEWAL))
        .groupBy(month_of("date_created").alias("month"))
        .agg(
            sum_if(kind == fv.SALE, "total").alias("new_revenue"),
            sum_if(kind == fv.RENEWAL, "total").alias("recurring_revenue"),
            money_sum("total").alias("total_revenue"),
        )
    )
    return by_month_series(monthly, "new_revenue", "recurring_revenue", "total_revenue")


def refunded_revenue_by_month(store: Store, as_of: Day, start: Day = None, end: Day = None) -> DataFrame:
    """Absolute value of the refunded sum per month."""
    refunds = within(store.orders.filter(F.col("status") == fv.REFUNDED), "date_created", start, end)
    monthly = refunds.groupBy(month_of("date_created").alias("month")).agg(
        F.abs(money_sum("total")).alias("value")
    )
    return by_month_series(monthly, "value")


def refund_rates_by_month(store: Store, as_of: Day, start: Day = None, end: Day = None) -> DataFrame:
    """Refunded orders as percent of complete and refunded ones.

    The range covers whole months. Renewal payments are not in the denominator.
    Orders without a date form a month of their own when no range is given.
    """
    status = F.col("status")
    rate = percent(
        count_if(status == fv.REFUNDED), count_if(status.isin(fv.COMPLETE, fv.REFUNDED))
    )
    return (
        within_months(store.orders, "date_created", start, end)
        .groupBy(month_of("date_created").alias("month"))
        .agg(F.coalesce(rate, F.lit(0.0)).alias("refund_rate"))
        .select(
            F.date_format("month", "yyyy-MM").alias("month_year"),
            month_label("month").alias("label"),
            "refund_rate",
        )
        .orderBy("month_year")
    )


def new_customer_refund_rates_by_year(
    store: Store, as_of: Day, start: Day = None, end: Day = None
) -> DataFrame:
    """Refund rate of root orders per year; without a range, finished years only."""
    orders = within(store.orders, "date_created", start, end)
    if not start and not end:
        orders = orders.filter(F.col("date_created") < at(required_day(as_of).replace(month=1, day=1)))
    root = F.col("parent") == 0
    return (
        orders.groupBy(F.year("date_created").alias("year"))
        .agg(
            count_if(root).alias("new_orders"),
            count_if(root & (F.col("status") == fv.REFUNDED)).alias("refunded_orders"),
        )
        .withColumn("refund_rate", percent(F.col("refunded_orders"), F.col("new_orders")))
        .orderBy("year")
    )


def customer_engagement_metrics(
    store: Store, as_of: Day, start: Day = None, end: Day = None
) -> DataFrame:
    """Active customers, orders, order value and order frequency per month."""
    monthly = (
        monthly_customer_sales(store, start, end)
        .groupBy("month")
        .agg(
            F.count("customer_id").alias("active_customers"),
            F.sum("orders").alias("total_orders"),
            F.sum("priced").alias("priced_orders"),
            money_of(F.sum("cents")).alias("revenue"),
        )
        .withColumn("avg_order_value", rounded_ratio(F.col("revenue"), F.col("priced_orders")))
        .withColumn("orders_per_customer", rounded_ratio(F.col("total_orders"), F.col("active_customers")))
    )
    return by_month_series(
        monthly, "active_customers", "total_orders", "avg_order_value", "orders_per_customer"
    )


def revenue_by_region(store: Store, as_of: Day, start: Day = None, end: Day = None) -> DataFrame:
    """Paid revenue per sales region of the billing address.

    An order with several billing addresses counts once per address in the sums
    and averages, and once per region in ``order_count``. Addresses are placed once,
    by order, and collapse there.
    """
    orders = paid_orders(store, start, end).select(F.col("id").alias("order_id"), "customer_id", cents_of("total").alias("cents"))
    return (
        with_billing_places(orders, store, region_of(F.col("country")))
        .groupBy(F.coalesce("place", F.lit(fv.REGION_OTHER)).alias("region"), "customer_id")
        .agg(
            rows("orders"),
            F.sum(F.when(F.col("cents").isNotNull(), F.col("copies"))).alias("copies"),
            F.sum(F.col("cents") * F.col("copies")).alias("cents"),
        )
        .groupBy("region")
        .agg(
            F.sum("orders").alias("order_count"),
            F.count("customer_id").alias("customer_count"),
            money_of(F.sum("cents"), 38).alias("total_revenue"),
            rounded_ratio(money_of(F.sum("cents")), F.sum("copies")).alias("avg_order_value"),
        )
        .orderBy(F.desc("total_revenue"), "region")
    )


def revenue_breakdown(
    store: Store,
    as_of: Day,
    start: Day = None,
    end: Day = None,
) -> DataFrame:
    """Revenue by customer history: new, existing, renewal, upgrade, total.

    A sale is *new* when the customer has no strictly earlier paid order, and an
    *upgrade* when it exceeds the mean of the earlier ones; upgrades are part of
    existing revenue too. History always reaches back to the first order,
    whatever the range. Orders without a customer have no history.
    """
    # Rows travel narrow: whole cents and one clock value. Equal orders of a moment travel as one row.
    # A row without customer or moment has no history, hence no owner.
    moment = F.unix_micros("date_created")
    paid = (
        within(store.orders.filter(is_paid()), "date_created", None, end)
        .groupBy(
            F.when(moment.isNotNull(), F.col("customer_id")).alias("owner"),
            "type",
            cents_of("total").alias("cents"),
            moment.alias("instant"),
        )
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    # An order counts in its customer's history even where its total is unknown.
    measured = paid.withColumns(
        {"priced": F.when(F.col("cents").isNotNull(), F.col("orders")), "amount": F.col("cents") * F.col("orders")}
    )
    measures = {"orders": "sum", "priced": "sum", "amount": "sum"}
    tracked = running_before(measured, "owner", "instant", measures).select(
        "type",
        "amount",
        "instant",
        F.col("orders_before").isNull().alias("is_first"),
        # total > mean of earlier, without dividing
        (F.col("cents").cast("decimal(19,0)") * F.col("priced_before") > F.col("amount_before")).alias("is_upgrade"),
    )
    sale = F.col("type") == fv.SALE
    parts = {
        "new_customer_revenue": sale & F.col("is_first"),
        "existing_customer_revenue": sale & ~F.col("is_first"),
        "renewal_revenue": F.col("type") == fv.RENEWAL,
        "upgrade_revenue": sale & F.col("is_upgrade"),
    }
    monthly = (
        within(tracked.withColumn("date_created", F.timestamp_micros("instant")), "date_created", start, None)
        .groupBy(month_of("date_created").alias("month"))
        .agg(
            *(money_of(F.sum(F.when(rule, F.col("amount")).otherwise(0))).alias(name) for name, rule in parts.items()),
            money_of(F.sum("amount")).alias("total_revenue"),
        )
    )
    return by_month_series(monthly, *parts, "total_revenue")


def _customer_amounts(store: Store) -> DataFrame:
    """One row per customer, or owner of orders: its paid amount, and whether it is a customer and ranked.

    Orders without a customer are a row of their own: they are in the total only.
    """
    spent = store.orders.groupBy(F.col("customer_id").alias("owner")).agg(sum_if(is_paid(), "total").alias("amount"))
    people = store.customers.select(F.col("id").alias("customer_id"))
    both = spent.join(people, F.col("owner") == F.col("customer_id"), "full")
    # Owners without a row in the customer table still spent something.
    return both.select(
        F.lit("Customers").alias("kind"),
        "amount",
        F.col("customer_id").isNotNull().alias("counted"),
        (F.col("customer_id").isNotNull() & F.col("amount").isNotNull()).alias("ranked"),
    )


def _product_amounts(store: Store) -> DataFrame:
    """One row per product of any order: its paid amount, ranked if there is one."""
    orders = paid_orders(store).select(F.col("id").alias("order_id"), F.lit(True).alias("paid"))
    amounts = (
        store.order_items.withColumnRenamed("total", "item_total")
        .join(orders, "order_id", "left")
        .groupBy("product_id")
        .agg(money_sum("item_total", F.col("paid")).alias("amount"), F.count("paid").alias("sold"))
    )
    return amounts.select(
        F.lit("Products").alias("kind"),
        "amount",
        F.col("product_id").isNotNull().alias("counted"),
        (F.col("sold") > 0).alias("ranked"),
    )


def revenue_concentration(store: Store, as_of: Day) -> DataFrame:
    """Share of revenue made by the top 10 % / 20 % of customers and 10 % of products.

    The customer quota is a share of all customers, but only those with an
    order are ranked; the product quota is a share of all products ever sold. One
    pass per customer and one per product give equal amounts with their numbers;
    from those come the quotas, the total and the ranks of both kinds. Ties at the
    edge have equal amounts, so taking part of them is exact.
    """
    kind, value = F.col("kind"), F.col("amount")
    amounts = (
        _customer_amounts(store)
        .unionByName(_product_amounts(store))
        .groupBy("kind", "amount")
        .agg(
            count_if(F.col("ranked") & value.isNotNull()).alias("n"),
            count_if(F.col("counted")).alias("members"),
            rows("owners"),
        )
        .filter(all_read("n", "members", "owners"))
    )

    def quota(of: str, share: str) -> Column:
        # decimal arithmetic: 0.1 * 30 must be exactly 3
        members = zero(F.sum(F.when(kind == of, F.col("members"))))
        return F.floor(members * F.lit(share).cast("decimal(3,2)")).cast("long")

    segments = {
        "tenth": ("Customers", "0.10", "Top 10% Customers"),
        "fifth": ("Customers", "0.20", "Top 20% Customers"),
        "best": ("Products", "0.10", "Top 10% Products"),
    }
    totals = amounts.agg(
        *(quota(of, share).alias(name) for name, (of, share, _) in segments.items()),
        F.sum(F.when(kind == "Customers", value * F.col("owners"))).alias("all_revenue"),
    )
    counts = amounts.filter("n > 0").select("kind", "amount", "n")
    ranks = value_ranks(counts, "amount", descending=True, within=["kind"]).crossJoin(F.broadcast(totals))
    taken = {
        name: F.when(kind == of, F.greatest(F.least(F.col("n"), F.col(name) - F.col("n_before")), F.lit(0))).otherwise(0)
        for name, (of, _, _) in segments.items()
    }
    sums = ranks.agg(
        *(zero(F.sum(n)).alias(f"{name}_count") for name, n in taken.items()),
        *(F.sum(F.when(n > 0, n * value)).alias(f"{name}_revenue") for name, n in taken.items()),
        F.max("all_revenue").alias("all_revenue"),
    )
    lines = F.array(
        *(
            F.struct(F.lit(label).alias("segment"), F.col(f"{name}_count").alias("count"), F.col(f"{name}_revenue").alias("revenue"))
            for name, (_, _, label) in segments.items()
        )
    )
    return sums.select(F.inline(lines), "all_revenue").select(
        "segment", "count", "revenue", percent(F.col("revenue"), F.col("all_revenue")).alias("revenue_percentage")
    )


def average_revenue_per_customer(
    store: Store, as_of: Day, start: Day = None, end: Day = None
) -> DataFrame:
    """Paid revenue per paying customer and month."""
    monthly = (
        monthly_customer_sales(store, start, end)
        .groupBy("month")
        .agg(rounded_ratio(money_of(F.sum("cents")), F.count("customer_id")).alias("avg_revenue_per_customer"))
    )
    return by_month_series(monthly, "avg_revenue_per_customer")


def payment_method_performance(
    store: Store, as_of: Day, start: Day = None, end: Day = None
) -> DataFrame:
    """Attempts, success rate and revenue per gateway; every order is an attempt."""
    paid = is_paid()
    paid_total = F.when(paid, F.col("total"))
    return (
        within(store.orders, "date_created", start, end)
        .groupBy(F.coalesce("gateway", F.lit("Unknown")).alias("payment_method"))
        .agg(
            rows("total_attempts"),
            count_if(paid).alias("successful_payments"),
            count_if(F.col("status") == fv.FAILED).alias("failed_payments"),
            percent(count_if(paid), F.count(F.lit(1))).alias("success_rate"),
            sum_if(paid, "total").alias("total_revenue"),
            rounded_ratio(money_sum("total", paid), F.count(paid_total)).alias("avg_transaction_value"),
        )
        .orderBy(F.desc("total_revenue"), "payment_method")
    )


def _recovery_events(moments: DataFrame) -> DataFrame:
    """Unfold orders into one time line per customer: what they add, what they ask.

    Four sub-steps per microsecond: month starts come first, then payments, then
    failures. A row sees strictly earlier steps only, so a payment does not see
    a failure of the same moment and a failure does see such a payment.

    A payment adds ``paid*`` and asks for the latest failure since ``since``, at
    its own moment for its own month and at month starts for the months before
    that its 30 days still touch. A failure adds ``failed_at`` and asks for the
    payment totals, at its own moment (negative ``weight``) and 30 days later.
    ``day`` is the failure's day, or the first day of the month asked about.
    ``failing`` counts failures; one without customer or moment does nothing else.
    """
    moment, n, failed = F.col("date_created"), F.col("n"), F.col("failed")
    micros = F.unix_micros(moment)
    day = F.unix_date(F.to_date(moment))
    fields = {
        "instant": "long", "day": "int", "weight": "long", "since": "long",
        "paid": "long", "paid_cents": "long", "paid_days": "long", "failed_at": "long", "failing": "long",
    }

    def event(**values: Column) -> Column:
        return F.struct(*(values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields.items()))

    opened = moment - F.expr("INTERVAL '30' DAY")
    months = [month_of(moment) - F.expr(f"INTERVAL '{k}' MONTH") for k in range(3)]

    def question(k: int) -> dict[str, Column]:
        return {
            "day": F.unix_date(F.to_date(months[k])),
            "weight": n,
            "since": F.unix_micros(F.greatest(opened, months[k])),
        }

    payment = event(
        instant=micros * 4 + 1, paid=n, paid_cents=F.col("cents"), paid_days=n * day, **question(0)
    )
    failure = event(instant=F.coalesce(micros * 4 + 2, F.lit(0)), day=day, weight=-n, failed_at=micros, failing=n)
    closing = F.when(F.col("owner").isNotNull(), event(instant=(micros + _RECOVERY_WINDOW) * 4 + 2, day=day, weight=n))
    before = [
        F.when(~failed & (opened < months[k - 1]), event(instant=F.unix_micros(months[k - 1]) * 4, **question(k)))
        for k in (1, 2)
    ]
    events = F.array(
        F.when(failed, failure).otherwise(payment), F.when(failed, closing).otherwise(before[0]), before[1]
    )
    return moments.select("owner", F.inline(events)).filter(F.col("instant").isNotNull())


def failed_payment_recovery(
    store: Store,
    as_of: Day,
    start: Day = None,
    end: Day = None,
) -> DataFrame:
    """Failed orders followed within 30 days by a paid order of the same customer.

    Revenue and days are totals over all (failed, paid) pairs; the recovered
    count is distinct paid orders per month of failure, so rates above 100 are
    possible. No pair is ever built: totals over "paid in (t, t + 30 days]" are
    the running total at ``t + 30 days`` minus the one at ``t``, and a paid
    order recovers a month when the latest failure before the month ends (or
    before the order) is at most 30 days old.
    """
    failing = (F.col("status") == fv.FAILED) & is_within(F.col("date_created"), start, end)
    # A row without customer or moment has nothing to do with others, hence no owner.
    owner = F.when(F.col("date_created").isNotNull(), F.col("customer_id"))
    # One row per moment of a customer: copies collapse before the shuffle.
    moments = (
        store.orders.filter(failing | (is_paid() & owner.isNotNull()))
        .groupBy(owner.alias("owner"), "date_created", (~is_paid()).alias("failed"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(cents_of("total")).alias("cents"))
    )
    measures = {"paid": "sum", "paid_cents": "sum", "paid_days": "sum", "failed_at": "max"}
    seen = running_before(_recovery_events(moments), "owner", "instant", measures, micro=4)
    asks_failure = F.col("since").isNotNull()
    weight = F.when(~asks_failure, F.col("weight"))
    recoveries = seen.groupBy(month_of(F.date_from_unix_date("day")).alias("month")).agg(
        F.sum("failing").alias("failed_count"),
        F.sum(F.when(asks_failure & (F.col("failed_at_before") >= F.col("since")), F.col("weight"))).alias("recovered"),
        F.sum(weight * zero("paid_before")).alias("pairs"),
        money_of(F.sum(weight * zero("paid_cents_before").cast("decimal(19,0)")), 38).alias("revenue"),
        F.sum(weight * (zero("paid_days_before") - F.col("day") * zero("paid_before"))).alias("days"),
    )
    monthly = (
        recoveries.filter("failed_count > 0")
        .withColumn("recovered_count", zero("recovered"))
        .withColumn("recovery_rate", percent(F.col("recovered_count"), F.col("failed_count")))
        .withColumn("recovered_revenue", F.coalesce("revenue", F.lit(0).cast("decimal(38,2)")))
        .withColumn("avg_days_to_recovery", rounded_ratio(F.col("days"), F.col("pairs"), 1))
    )
    return by_month_series(
        monthly,
        "failed_count",
        "recovered_count",
        "recovery_rate",
        "recovered_revenue",
        "avg_days_to_recovery",
    )


def revenue_velocity(store: Store, as_of: Day, start: Day = None, end: Day = None) -> DataFrame:
    """Monthly revenue with change, growth and acceleration.

    Months without revenue are absent, and the previous month is the previous
    *present* month. The window runs over one row per month.
    """
    monthly = (
        paid_orders(store, start, end)
        .groupBy(month_of("date_created").alias("month"))
        .agg(money_sum("total").alias("monthly_revenue"))
    )
    order = Window.orderBy("month")
    revenue, previous = F.col("monthly_revenue"), F.col("previous_month_revenue")
    series = (
        monthly.withColumn("previous_month_revenue", F.lag("monthly_revenue").over(order))
        .withColumn("before_previous", F.lag("monthly_revenue", 2).over(order))
        .withColumn("revenue_change", revenue - previous)
        .withColumn("growth_rate", percent_change(revenue, previous))
        .withColumn("acceleration", (revenue - previous) - (previous - F.col("before_previous")))
    )
    return by_month_series(
        series,
        "monthly_revenue",
        "previous_month_revenue",
        "revenue_change",
        "growth_rate",
        "acceleration",
    )
