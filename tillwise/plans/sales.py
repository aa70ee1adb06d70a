"""Paid orders, sold items and billing countries.

Order ids are a primary key, so counting orders means counting rows; the
DISTINCT of a plain SQL formulation would shuffle every id for nothing.
Distinct customers are counted in two steps (group by customer, then count),
which combines on the map side and spreads a busy customer over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import fixed_values as fv
from tillwise.functions.dates import Day, month_of, non_negative, within
from tillwise.functions.labels import is_paid
from tillwise.functions.numbers import cents_of, money_of
from tillwise.plans.ranges import first_rows, sort_columns
from tillwise.sources.store import Store


# A limited list of up to so many rows is merged in one task.
MERGED = 100_000


def paid_orders(store: Store, start: Day = None, end: Day = None) -> DataFrame:
    return within(store.orders.filter(is_paid()), "date_created", start, end)


def rows(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def zero(column: str | Column) -> Column:
    """The column, with 0 for NULL (an aggregate over no rows)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column, F.lit(0))


def sum_if(condition: Column, amount: str) -> Column:
    """Sum of the amounts that satisfy a condition; 0 if none of some rows does."""
    return money_of(F.sum(F.when(condition, cents_of(amount)).otherwise(0)))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


# Slots of a placement of its own: any number does, as they are part of the key.
_SLOTS = 1 << 20


def totals_apart(df: DataFrame, keys: Sequence[str], *totals: Column) -> DataFrame:
    """One row per ``keys`` with ``totals``, to be joined to raw rows on ``keys``.

    Spark splits the many rows of one key in a join only where both sides come
    straight from a shuffle. An aggregated side does not: the join takes over the
    placement of the aggregation, and a hot key is one task. Here the aggregation
    is placed by the keys and a slot made of them, which no join can take over, so
    the totals (one row per key) are shuffled once more and the raw rows can be split.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(_SLOTS)).alias("slot")
    return df.groupBy(*keys, slot).agg(*(totals or (rows("slots"),))).drop("slot", *(() if totals else ("slots",)))


def monthly_customer_sales(store: Store, start: Day = None, end: Day = None) -> DataFrame:
    """Paid orders per month and customer: ``month, customer_id, orders, priced, cents``.

    ``priced`` counts the orders whose total is known: means of totals divide by it.
    """
    return (
        paid_orders(store, start, end)
        .groupBy(month_of("date_created").alias("month"), "customer_id")
        .agg(rows("orders"), F.count("total").alias("priced"), F.sum(cents_of("total")).alias("cents"))
    )


def items_of(store: Store, orders: DataFrame) -> DataFrame:
    """Items of ``orders`` (``order_id`` and other columns), with the columns of their order.

    The next aggregation never runs on the order id alone, so a hot order can
    be split by the adaptive skew join.
    """
    return store.order_items.withColumnRenamed("total", "item_total").join(orders, "order_id")


def sold_items(
    store: Store, start: Day = None, end: Day = None, *order_columns: str
) -> DataFrame:
    """Items of paid orders, with the wanted columns of their order."""
    return items_of(store, paid_orders(store, start, end).select(F.col("id").alias("order_id"), *order_columns))


def with_billing_places(orders: DataFrame, store: Store, place: Column) -> DataFrame:
    """One row per order (``order_id`` and the other columns) and place of its billing addresses, with ``copies``.

    ``place`` is an expression on ``country``; orders without billing address keep a
    NULL place and one copy. Addresses meet their orders as they are, one shuffle
    for each; the repeated ones collapse where the join has put them. An order has
    few addresses, and one with very many can be split by the adaptive skew join.
    """
    billing = store.order_addresses.filter(F.col("type") == fv.BILLING).select("order_id", place.alias("place"))
    return orders.join(billing, "order_id", "left").groupBy(*orders.columns, "place").agg(rows("copies"))


def with_titles(df: DataFrame, store: Store) -> DataFrame:
    """Add ``product_name``; products without a title row keep NULL."""
    titles = store.products.select(
        F.col("id").alias("product_id"), F.col("post_title").alias("product_name")
    )
    return df.join(titles, "product_id", "left")


def head(df: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows in the given order, or all of them for None.

    ``order`` has no ties; ``"-name"`` is descending (see :func:`sort_columns`). A list
    of up to ``MERGED`` rows is found by keeping the best rows of every task and
    merging them in one. Longer lists are cut by rank.
    """
    sorts, columns = sort_columns(order)
    if limit is None:
        return df.orderBy(*sorts)
    if non_negative("limit", limit) <= MERGED:
        return df.orderBy(*sorts).limit(limit)
    return first_rows(df, limit, columns).orderBy(*sorts)
