"""Product performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions import fixed_values as fv
from tillwise.functions.dates import (
    Day,
    at,
    is_within,
    month_date,
    month_label,
    month_of,
    required_day,
    shift_months,
)
from tillwise.functions.labels import first_match, position
from tillwise.functions.numbers import cents_of, money_of, money_sum, percent_change, ratio, rounded, rounded_ratio
from tillwise.plans.prefix import all_read
from tillwise.plans.sales import count_if, head, items_of, paid_orders, rows, sold_items, sum_if, totals_apart, with_titles, zero
from tillwise.sources.store import Store

__all__ = [
    "top_products",
    "product_growth_trends",
    "product_performance_matrix",
    "bundle_performance",
    "product_lifecycle_stages",
]

LIFECYCLE_STAGES = ("Introduction", "Growth", "Maturity", "Decline", "End of Life")


def top_products(
    store: Store, as_of: Day, start: Day = None, end: Day = None, limit: int | None = 20
) -> DataFrame:
    """Best sellers by revenue; ``avg_price`` is the plain mean of line prices.

    Lines are first totalled per product and order: the join has already placed
    them by order, so counting orders afterwards needs no further shuffle.
    """
    price = ratio(F.col("item_total"), F.col("quantity"))
    top = (
        sold_items(store, start, end)
        .groupBy("product_id", "order_id")
        .agg(
            F.sum("quantity").alias("units"),
            F.sum(cents_of("item_total")).alias("cents"),
            F.sum(price).alias("prices"),
            F.count(price).alias("priced"),
        )
        .groupBy("product_id")
        .agg(
            rows("order_count"),
            F.sum("units").alias("units_sold"),
            money_of(F.sum("cents"), 38).alias("total_revenue"),
            rounded(ratio(F.sum("prices"), F.sum("priced"))).alias("avg_price"),
            rounded_ratio(money_of(F.sum("cents")), F.count(F.lit(1))).alias("aov"),
        )
        .transform(head, limit, "-total_revenue", "product_id")
    )
    return (
        with_titles(top, store)
        .select("product_id", "product_name", "order_count", "units_sold", "total_revenue", "avg_price", "aov")
        .orderBy(F.desc("total_revenue"), "product_id")
    )


def product_growth_trends(
    store: Store, as_of: Day, start: Day = None, end: Day = None, limit: int | None = 10
) -> DataFrame:
    """Monthly sales of the products with the highest all-time revenue.

    The choice ignores the range, the series respects it. Both come from one
    pass: per product and month, then per product with its months in an array
    (as many as the shop has months), which the winners unfold again.
    """
    listed = is_within(F.col("date_created"), start, end)
    monthly = (
        sold_items(store, None, None, "date_created")
        .groupBy("product_id", "order_id", "date_created")
        .agg(F.sum("quantity").alias("units"), F.sum(cents_of("item_total")).alias("cents"))
        .groupBy("product_id", month_of("date_created").alias("month"))
        .agg(
            F.sum("cents").alias("all_cents"),
            F.sum(F.when(listed, F.col("units"))).alias("units_sold"),
            money_of(F.sum(F.when(listed, F.col("cents"))), 38).alias("revenue"),
            F.count(F.when(listed, F.lit(1))).alias("order_count"),
        )
    )
    top = (
        monthly.groupBy("product_id")
        .agg(
            F.sum("all_cents").alias("ranking"),
            F.collect_list(F.struct("month", "units_sold", "revenue", "order_count")).alias("months"),
        )
        .transform(head, limit, "-ranking", "product_id")
    )
    return (
        with_titles(top, store)
        .select("product_id", "product_name", F.inline("months"))
        .filter(F.col("order_count") > 0)
        .select(
            month_date("month").alias("date"),
            month_label("month").alias("label"),
            "product_id",
            "product_name",
            "units_sold",
            "revenue",
            "order_count",
        )
        .orderBy("date", F.desc("revenue"), "product_id")
    )


def product_performance_matrix(
    store: Store, as_of: Day, start: Day = None, end: Day = None
) -> DataFrame:
    """Products sold in the last three months, by revenue and growth quadrant.

    Revenue is compared with the mean over products sold in those months, growth
    with the mean growth of all products; both means ignore the range and need
    the last six months only. Unknown growth makes a product a Dog.
    """
    today = required_day(as_of)
    three, six = shift_months(today, -3), shift_months(today, -6)
    sold_at = F.col("date_created")
    recent = sold_at >= at(three)
    earlier = (sold_at >= at(six)) & (sold_at < at(three))
    listed = is_within(sold_at, start, end)

    # Items meet their orders once: those of the range and those of the last six months.
    orders = paid_orders(store).filter(listed | (sold_at >= at(six)))
    per_product = (
        items_of(store, orders.select(F.col("id").alias("order_id"), "date_created"))
        .groupBy("product_id")
        .agg(
            money_sum("item_total", recent).alias("now"),
            sum_if(recent, "item_total").alias("current"),
            sum_if(earlier, "item_total").alias("previous"),
            count_if(sold_at >= at(six)).alias("lately"),
            sum_if(listed & recent, "item_total").alias("current_revenue"),
            sum_if(listed & earlier, "item_total").alias("previous_revenue"),
            F.sum(F.when(listed, F.col("quantity"))).alias("units_sold"),
        )
        .filter(all_read("now", "current", "previous", "lately", "current_revenue", "previous_revenue", "units_sold"))
    )
    means = per_product.filter(F.col("lately") > 0).agg(
        F.sum("now").alias("now_total"),
        F.count("now").alias("now_products"),
        F.avg(100.0 * ratio(F.col("current") - F.col("previous"), F.col("previous"))).alias("avg_growth"),
    )
    products = per_product.filter(F.col("current_revenue") > 0).withColumn(
        "growth_rate", percent_change(F.col("current_revenue"), F.col("previous_revenue"))
    )
    # revenue >= total / products, without dividing
    strong = F.col("current_revenue") * F.col("now_products") >= F.col("now_total")
    rising, falling = F.col("growth_rate") >= F.col("avg_growth"), F.col("growth_rate") < F.col("avg_growth")
    quadrant = first_match(
        ((strong & rising, "Star"), (strong & falling, "Cash Cow"), (~strong & rising, "Question Mark")), "Dog"
    )
    return (
        with_titles(products, store)
        .crossJoin(F.broadcast(means))
        .select(
            "product_id",
            "product_name",
            "current_revenue",
            "previous_revenue",
            "growth_rate",
            "units_sold",
            quadrant.alias("quadrant"),
        )
        .orderBy(F.desc("current_revenue"), "product_id")
    )


def meta_rows(store: Store, key: str) -> DataFrame:
    return store.product_meta.filter((F.col("meta_key") == key) & F.col("post_id").isNotNull())


def bundle_marks(store: Store) -> DataFrame:
    """``product_id, post_parent, marks, blanks``: bundle attribute rows with and without a value, of every product."""
    nothing = F.lit(0).cast("long")
    products = store.products.select(
        F.col("id").alias("product_id"), "post_parent", F.lit(1).alias("known"), nothing.alias("marks"), nothing.alias("blanks")
    )
    filled = F.col("meta_value").isNotNull().cast("long")
    attributes = meta_rows(store, fv.META_BUNDLE).select(
        F.col("post_id").alias("product_id"),
        F.lit(None).cast("long").alias("post_parent"), F.lit(None).cast("int").alias("known"),
        filled.alias("marks"), (1 - filled).alias("blanks"),
    )
    described = totals_apart(
        products.unionByName(attributes),
        ["product_id"],
        F.max("post_parent").alias("post_parent"), F.count("known").alias("known"),
        F.sum("marks").alias("marks"), F.sum("blanks").alias("blanks"),
    )
    return described.filter(F.col("known") > 0).drop("known")


def split_by_type(per_product: DataFrame, child_is_bundle: bool) -> DataFrame:
    """One row per product and type with the ``weight`` its attribute rows give it.

    A product repeats once per bundle attribute row; rows with a value make it a
    Bundle, rows without (or no rows at all) an Individual.
    """
    marks, blanks = zero("marks"), zero("blanks")
    bundle, single = marks, F.greatest(blanks, F.when(marks == 0, 1).otherwise(0))
    if child_is_bundle:
        child = zero("post_parent") > 0
        bundle, single = F.when(child, bundle + single).otherwise(bundle), F.when(~child, single).otherwise(0)
    kinds = F.array(
        F.struct(F.lit("Bundle").alias("type"), bundle.cast("long").alias("weight")),
        F.struct(F.lit("Individual").alias("type"), single.cast("long").alias("weight")),
    )
    exploded = per_product.withColumn("kind", F.explode(kinds)).filter(F.col("kind.weight") > 0)
    return exploded.select(
        "*", F.col("kind.type").alias("product_type"), F.col("kind.weight").alias("weight")
    ).drop("kind", "marks", "blanks", "post_parent")


def bundle_performance(store: Store, as_of: Day, start: Day = None, end: Day = None) -> DataFrame:
    """Bundles against individual products.

    A product is a bundle when it has a parent or a bundle attribute. Items meet
    their orders once, are totalled per product, order and customer where the join
    has put them, and are placed by product once, with the marks of the product.
    There the amounts are totalled per product before the type is attached; distinct
    orders and customers are counted per type.
    """
    lines = (
        sold_items(store, start, end, "customer_id")
        .groupBy("product_id", "order_id", "customer_id")
        .agg(F.count("item_total").alias("lines"), F.sum("quantity").alias("units"), F.sum(cents_of("item_total")).alias("cents"))
    )
    described = lines.join(bundle_marks(store), "product_id", "left").filter(
        all_read("order_id", "customer_id", "lines", "units", "cents", "post_parent", "marks", "blanks")
    )
    amounts = (
        split_by_type(
            described.groupBy("product_id").agg(
                F.sum("lines").alias("lines"), F.sum("units").alias("units"), money_of(F.sum("cents")).alias("revenue"),
                *(F.max(name).alias(name) for name in ("post_parent", "marks", "blanks")),
            ),
            child_is_bundle=True,
        )
        .groupBy("product_type")
        .agg(
            F.count("product_id").alias("product_count"),
            F.sum(F.col("weight") * F.col("units")).alias("units_sold"),
            F.sum(F.col("weight") * F.col("revenue")).alias("total_revenue"),
            F.sum(F.col("weight") * F.col("lines")).alias("sales"),
        )
    )
    buyers = (
        split_by_type(described, child_is_bundle=True)
        .groupBy("product_type", "order_id", "customer_id").agg(rows())
        .groupBy("product_type", "customer_id").agg(rows("orders"))
        .groupBy("product_type")
        .agg(F.sum("orders").alias("order_count"), F.count("customer_id").alias("customers"))
    )
    return (
        amounts.join(buyers, "product_type")
        .select(
            "product_type",
            "product_count",
            "order_count",
            "units_sold",
            "total_revenue",
            rounded_ratio(F.col("total_revenue"), F.col("sales")).alias("avg_revenue_per_sale"),
            rounded_ratio(F.col("total_revenue"), F.col("customers")).alias("revenue_per_customer"),
        )
        .orderBy(F.desc("total_revenue"), "product_type")
    )


def product_lifecycle_stages(store: Store, as_of: Day, dedupe: bool = False) -> DataFrame:
    """Lifecycle stage by age and month-on-month trend; unknown trend is End of Life.

    The original report repeats every sale once per month in which the product
    sold, so ``current_revenue`` is multiplied by that number of months (trend
    and peak are not affected). ``dedupe=True`` gives the plain revenue.
    """
    today = required_day(as_of)
    one, two = shift_months(today, -1), shift_months(today, -2)
    sold_at = F.col("date_created")
    copies = F.lit(1) if dedupe else F.count(F.lit(1))
    trend, age = F.col("revenue_trend"), F.col("months_active")
    stage = first_match(
        (
            ((age <= 3) & (trend > 20), "Introduction"),
            (trend > 10, "Growth"),
            (trend.between(-10, 10), "Maturity"),
            ((trend < -10) & (trend >= -30), "Decline"),
        ),
        "End of Life",
    )
    products = (
        sold_items(store, None, None, "date_created")
        .groupBy("product_id", month_of("date_created").alias("month"))
        .agg(
            money_sum("item_total").alias("revenue"),
            sum_if(sold_at >= at(one), "item_total").alias("current"),
            sum_if((sold_at >= at(two)) & (sold_at < at(one)), "item_total").alias("previous"),
            F.min("date_created").alias("first_sale"),
            F.max("date_created").alias("last_sale"),
        )
        .groupBy("product_id")
        .agg(
            F.min("first_sale").alias("first_sale"),
            F.max("last_sale").alias("last_sale_date"),
            F.max("revenue").alias("peak_revenue"),
            (F.sum("current") * copies).alias("current_revenue"),
            percent_change(F.sum("current"), F.sum("previous")).alias("revenue_trend"),
        )
        .withColumn("months_active", F.timestamp_diff("MONTH", F.col("first_sale"), at(today)))
        .filter(age > 0)
    )
    return (
        with_titles(products, store)
        .select(
            "product_id",
            "product_name",
            "months_active",
            "revenue_trend",
            "current_revenue",
            "peak_revenue",
            stage.alias("lifecycle_stage"),
            "last_sale_date",
        )
        .orderBy(position(F.col("lifecycle_stage"), LIFECYCLE_STAGES), F.desc("current_revenue"), "product_id")
    )
