"""Dashboard summaries: thin steps over report results.

Each function takes DataFrames of the shape named in its docstring, usually the
result of a report, and stays inside one Spark plan: a list of all customers is
counted where it lies, not sent to a client first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions import fixed_values as fv
from tillwise.functions.labels import first_match, position, rfm_segment, trend_class
from tillwise.functions.numbers import percent, ratio, rounded
from tillwise.plans.ranges import label_places, ranged
from tillwise.plans.prefix import prefix_before, value_levels
from tillwise.plans.sales import count_if, rows, zero

__all__ = [
    "mrr_growth",
    "average_renewal_rate",
    "refund_trailing_summary",
    "customer_summary",
    "rfm_bucket_counts",
    "health_distribution",
    "top_clv_rows",
    "product_summary",
    "product_search",
    "bcg_quadrant",
    "with_trend_class",
    "recurring_share",
    "revenue_waterfall",
    "revenue_by_source_share",
    "pareto",
    "cohort_heatmap",
    "latest_daily_revenue",
    "business_health_score",
    "quick_wins",
    "risk_alerts",
]


# Keys of equal amounts that are summed up in one task.
_KEY_RANGE = 1 << 16


def _number(column: str | Column) -> Column:
    """DOUBLE with 0 for a missing value."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("double"), F.lit(0.0))


def _fallback(ranged: DataFrame, everything: DataFrame | None) -> DataFrame:
    """Rows of ``ranged``, or of ``everything`` when ``ranged`` is empty."""
    if everything is None:
        return ranged
    found = ranged.limit(1).agg(rows("found"))
    spare = everything.crossJoin(F.broadcast(found)).filter(F.col("found") == 0).drop("found")
    return ranged.unionByName(spare)


def _first_filled(ranged: DataFrame, everything: DataFrame | None, **measures: Column) -> DataFrame:
    """One row of aggregates over ``ranged``, or over ``everything`` when ``ranged`` is empty.

    Both are aggregated side by side, so that neither report runs twice.
    """
    tagged = ranged.withColumn("choice", F.lit(1))
    if everything is not None:
        tagged = tagged.unionByName(everything.withColumn("choice", F.lit(2)))
    per_choice = tagged.groupBy("choice").agg(*(c.alias(n) for n, c in measures.items()))
    return per_choice.agg(*(F.min_by(n, "choice").alias(n) for n in measures))


def mrr_growth(breakdown: DataFrame) -> DataFrame:
    """From the current MRR breakdown: growth in percent of existing, and net new MRR."""
    net = F.col("new_mrr") - F.col("churned_mrr")
    return breakdown.select(
        (100.0 * ratio(net, F.col("existing_mrr"))).alias("growth_rate"), net.alias("net_new_mrr")
    )


def average_renewal_rate(rates: DataFrame, all_time: DataFrame | None = None) -> DataFrame:
    """Plain mean of monthly renewal rates; the all-time series stands in for an empty one."""
    return _first_filled(rates, all_time, avg_renewal_rate=F.avg("renewal_rate"))


def refund_trailing_summary(rates: DataFrame, refunded: DataFrame, months: int = 12) -> DataFrame:
    """Mean and latest refund rate, summed and latest refunded revenue, over the last 12 rows."""
    rate = rates.orderBy(F.desc_nulls_last("month_year")).limit(months).agg(
        F.avg("refund_rate").alias("avg_refund_rate"),
        F.max_by("refund_rate", "month_year").alias("last_refund_rate"),
    )
    money = refunded.orderBy(F.desc_nulls_last("date")).limit(months).agg(
        F.sum("value").alias("refunded_revenue"),
        F.max_by("value", "date").alias("last_refunded_revenue"),
    )
    return rate.crossJoin(F.broadcast(money))


def customer_summary(clv: DataFrame, rfm: DataFrame, health: DataFrame) -> DataFrame:
    """Distinct customers of both lists, mean listed lifetime value, health rows at risk.

    The health list is the best-first top list, so "at risk" counts inside it.
    """
    people = (
        rfm.select("customer_id").unionByName(clv.select("customer_id")).distinct()
        .agg(rows("total_customers"))
    )
    value = clv.agg(F.coalesce(F.avg(_number("total_spent")), F.lit(0.0)).alias("avg_clv"))
    risk = health.agg(count_if(F.lower("health_status").contains("risk")).alias("at_risk"))
    return people.crossJoin(F.broadcast(value)).crossJoin(F.broadcast(risk))


def rfm_bucket_counts(rfm: DataFrame) -> DataFrame:
    """Customers per segment, all seven segments present."""
    scores = (zero(f"{name}_score") for name in ("recency", "frequency", "monetary"))
    counts = rfm.groupBy(rfm_segment(*scores).alias("segment")).agg(rows("counted"))
    labels = rfm.sparkSession.createDataFrame([(name,) for name in fv.RFM_SEGMENTS], "segment string")
    return (
        labels.join(counts, "segment", "left")
        .select("segment", zero("counted").alias("customer_count"))
        .orderBy(position(F.col("segment"), fv.RFM_SEGMENTS))
    )


def health_distribution(health: DataFrame) -> DataFrame:
    """Customers per health status; a missing status is Unknown."""
    status = F.coalesce(F.nullif("health_status", F.lit("")), F.lit("Unknown"))
    return (
        health.groupBy(status.alias("health_status"))
        .agg(rows("customer_count"))
        .orderBy(F.desc("customer_count"), "health_status")
    )


def top_clv_rows(clv: DataFrame) -> DataFrame:
    """Table rows of the lifetime value list; the e-mail stands in for an empty name."""
    return clv.select(
        F.col("customer_id").alias("id"),
        F.coalesce(F.nullif("name", F.lit("")), F.col("email")).alias("name"),
        _number("total_spent").alias("total"),
        _number("avg_order_value").alias("aov"),
        zero("purchase_count").alias("orders"),
    ).orderBy(F.desc("total"), "id")


def product_summary(matrix: DataFrame, all_time: DataFrame | None = None) -> DataFrame:
    """Totals and means of the product matrix; unknown growth counts as 0."""
    return _first_filled(
        matrix,
        all_time,
        total_revenue=F.sum("current_revenue"),
        total_units=F.sum(zero("units_sold")),
        avg_growth=F.avg(_number("growth_rate")),
        active_products=count_if(F.col("current_revenue") > 0),
    ).withColumn("avg_aov", F.coalesce(ratio(F.col("total_revenue"), F.col("total_units")), F.lit(0.0)))


def product_search(
    products: DataFrame,
    term: str = "",
    quadrant: str = "all",
    sort: str = "revenue",
    descending: bool = True,
) -> DataFrame:
    """Search, quadrant filter and sort of the best-seller list.

    The quadrant compares with the means of the rows the search left. Rows
    without ``growth_rate`` (the best-seller list has none) grow by 0.
    """
    found = products.filter(F.coalesce(F.lower("product_name"), F.lit("")).contains(F.lit(term.lower())))
    if quadrant != "all":
        revenue = _number("total_revenue")
        growth = _number("growth_rate") if "growth_rate" in found.columns else F.lit(0.0)
        means = found.agg(F.avg(revenue).alias("mean_revenue"), F.avg(growth).alias("mean_growth"))
        strong, rising = revenue >= F.col("mean_revenue"), growth >= F.col("mean_growth")
        rules = {
            "stars": strong & rising,
            "cash-cows": strong & ~rising,
            "question-marks": ~strong & rising,
            "dogs": ~strong & ~rising,
        }
        if quadrant not in rules:
            raise ValueError(f"unknown quadrant {quadrant!r}; expected all or one of {sorted(rules)}")
        found = (
            found.crossJoin(F.broadcast(means)).filter(rules[quadrant]).drop("mean_revenue", "mean_growth")
        )
    key = _number("total_revenue" if sort == "revenue" else sort)
    return found.orderBy(key.desc() if descending else key.asc(), "product_id")


def bcg_quadrant(matrix: DataFrame, all_time: DataFrame | None = None) -> DataFrame:
    """The matrix classified again on the means of its own rows, unknown growth as 0.

    Can disagree with the quadrant the report itself gives.
    """
    rows_ = _fallback(matrix, all_time)
    revenue, growth = _number("current_revenue"), _number("growth_rate")
    means = rows_.agg(
        ratio(F.sum("current_revenue"), F.count(F.lit(1))).alias("mean_revenue"),
        F.avg(growth).alias("mean_growth"),
    )
    strong, rising = revenue >= F.col("mean_revenue"), growth >= F.col("mean_growth")
    label = first_match(
        ((strong & rising, "Star"), (strong & ~rising, "Cash Cow"), (~strong & rising, "Question Mark")), "Dog"
    )
    return (
        rows_.crossJoin(F.broadcast(means))
        .select("product_id", "product_name", revenue.alias("revenue"), growth.alias("growth"), label.alias("quadrant"))
        .orderBy(F.desc("revenue"), "product_id")
    )


def with_trend_class(df: DataFrame, growth: str = "growth_rate") -> DataFrame:
    """Add ``trend``: up above 5 %, down below -5 %, else flat (also for unknown growth)."""
    return df.withColumn("trend", trend_class(F.col(growth)))


def recurring_share(sources: DataFrame, velocity: float | None = None) -> DataFrame:
    """Total of ``(source, revenue)``, the recurring share of it, and a velocity grade."""
    whole = F.sum("revenue")
    recurring = F.sum(F.when(F.col("source") == "recurring", F.col("revenue")))
    speed = F.lit(float(velocity or 0))
    return sources.agg(
        _number(whole).alias("total"),
        F.when(whole > 0, _number(100.0 * ratio(recurring, whole))).otherwise(0.0).alias("recurring_percentage"),
    ).select(
        "total",
        "recurring_percentage",
        speed.alias("velocity"),
        first_match(((speed > 5, "excellent"), (speed > 2, "good"), (speed > 0, "fair")), "poor").alias("health"),
    )


def revenue_waterfall(sources: DataFrame) -> DataFrame:
    """Six steps from starting to ending revenue, from ``(source, revenue)``."""
    kinds = ("starting", "new", "expansion", "contraction", "churn")
    one = sources.agg(
        *(_number(F.sum(F.when(F.col("source") == kind, F.col("revenue")))).alias(kind) for kind in kinds)
    )
    start, new, more, less, lost = (F.col(kind) for kind in kinds)
    steps = (
        ("Starting", start),
        ("New Sales", new),
        ("Expansion", more),
        ("Contraction", -F.abs(less)),
        ("Churn", -F.abs(lost)),
        ("Ending", start + new + more - less - lost),
    )
    listed = F.array(
        *(
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("step"), value.alias("value"))
            for i, (name, value) in enumerate(steps, 1)
        )
    )
    return one.select(F.inline(listed)).orderBy("position")


def revenue_by_source_share(sources: DataFrame) -> DataFrame:
    """New, recurring and expansion revenue with capitalised names and their share."""
    kept = sources.filter(F.col("source").isin("new", "recurring", "expansion")).select(
        F.initcap("source").alias("name"), _number("revenue").alias("value")
    )
    total = kept.agg(F.sum("value").alias("whole"))
    return (
        kept.crossJoin(F.broadcast(total))
        .select("name", "value", rounded(100.0 * ratio(F.col("value"), F.col("whole"))).alias("share"))
        .orderBy("name")
    )


def pareto(df: DataFrame, revenue: str = "revenue", key: str = "id") -> DataFrame:
    """Running revenue over the rows, largest first, and its share of the total.

    ``revenue`` is a decimal amount, ``key`` identifies the row and orders equal
    amounts. The running total goes over blocks of amounts, and rows of one
    amount over ranges of keys (text keys are cut where they crowd), so neither a
    long list nor a crowd of equal amounts ends up in a single task.
    """
    integral = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    known = df.filter(F.col(revenue).isNotNull())
    known = known.withColumn("bucket", F.floor(F.col(key) / _KEY_RANGE)) if integral else ranged(known, [key], "bucket")
    cells = known.withColumns(value_levels(F.col(revenue), descending=True))
    levels = ["super", "block", "fine", "bucket"]
    totals = cells.groupBy(*levels).agg(F.sum(revenue).alias("amount"))
    before = prefix_before(totals, [], levels, {"amount": "sum"}).drop("amount")
    whole = df.agg(F.sum(revenue).alias("whole"))
    inside = Window.partitionBy(*levels).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    running = (
        cells.join(before, levels)
        .withColumn("running", zero("amount_before") + F.sum(revenue).over(inside))
        .crossJoin(F.broadcast(whole))
    )
    return running.select(
        key,
        revenue,
        F.col("running").alias("cumulative_revenue"),
        percent(F.col("running"), F.col("whole")).alias("cumulative_percentage"),
    )


def cohort_heatmap(cohorts: DataFrame) -> DataFrame:
    """``(month_idx, cohort_idx, revenue)`` with 0-based positions of the sorted labels.

    Labels are ranked by ranges of their distinct values, never in one task.
    """
    peak = cohorts.agg(F.max(_number("revenue")).alias("max_revenue"))
    return (
        cohorts.join(label_places(cohorts, "cohort", "cohort_idx"), "cohort")
        .join(label_places(cohorts, "month_number", "month_idx"), "month_number")
        .crossJoin(F.broadcast(peak))
        .select("month_idx", "cohort_idx", _number("revenue").alias("revenue"), "max_revenue")
    )


def latest_daily_revenue(daily: DataFrame) -> DataFrame:
    """Revenue of the last day of ``(date, revenue)``, 0 without days."""
    return daily.agg(_number(F.max_by("revenue", "date")).alias("latest_revenue"))


def business_health_score(periods: DataFrame) -> DataFrame:
    """Score 0-100 per period from revenue, churn, MRR and customer growth."""

    def momentum(level: str, change: str) -> Column:
        return F.when(F.col(level) > 0, F.least(_number(change) + 50, F.lit(100.0))).otherwise(50.0)

    churn = F.greatest(100 - 10 * _number("churn_rate"), F.lit(0.0))
    weighted = (
        momentum("total_revenue", "revenue_change") * 0.35
        + churn * 0.25
        + momentum("current_mrr", "mrr_growth") * 0.25
        + momentum("new_customers", "customer_change") * 0.15
    )
    # half up, also below zero
    score = F.floor(weighted + 0.5 + 1e-9).cast("int")
    status = first_match(
        (
            (F.col("health_score").isNull() | (F.col("health_score") == 0), "Loading..."),
            (F.col("health_score") >= 80, "Excellent"),
            (F.col("health_score") >= 60, "Good"),
            (F.col("health_score") >= 40, "Needs Attention"),
        ),
        "Critical",
    )
    return periods.select("period", score.alias("health_score")).withColumn("status", status)


def _fired(periods: DataFrame, rules: list[tuple[Column, dict[str, Column]]], default: Column | None) -> DataFrame:
    """One row per period and rule that holds; NULL never fires a rule."""
    candidates = [F.when(condition, F.struct(*(c.alias(n) for n, c in fields.items()))) for condition, fields in rules]
    hits = F.filter(F.array(*candidates), lambda hit: hit.isNotNull())
    if default is not None:
        hits = F.when(F.size(hits) > 0, hits).otherwise(F.array(default))
    return periods.select("period", F.inline(hits))


def _one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", rounded(value, 1))


def quick_wins(periods: DataFrame) -> DataFrame:
    """Good news per period: revenue, MRR, churn and signups; a default line if none.

    Unknown churn counts as no churn, as it does in the health score.
    """
    # The message texts.

    def win(title: str, *text: Column | str) -> dict[str, Column]:
        parts = [F.lit(t) if isinstance(t, str) else t for t in text]
        return {"title": F.lit(title), "description": F.concat(*parts)}

    revenue, mrr, churn = F.col("revenue_change"), F.col("mrr_growth"), _number("churn_rate")
    people = F.col("new_customers")
    rules = [
        (revenue > 10, win("Strong Revenue Growth", "Revenue up ", _one_decimal(revenue), "% vs previous period")),
        (mrr > 5, win("MRR Expanding", "MRR growing ", _one_decimal(mrr), "% month-over-month")),
        (churn < 5, win("Low Churn Rate", "Customer retention at ", _one_decimal(100 - churn), "%")),
        (people > 50, win("Customer Acquisition", people.cast("string"), " new customers this period")),
    ]
    steady = win("Steady Performance", "Continue monitoring key metrics for opportunities")
    return _fired(periods, rules, F.struct(*(c.alias(n) for n, c in steady.items())))


def _shortest(number: Column) -> Column:
    """A number as text: whole ones without a fraction, others in their shortest form."""
    return F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))


def risk_alerts(periods: DataFrame) -> DataFrame:
    """Warnings per period: churn, revenue decline, MRR contraction."""
    # The message texts.

    def alert(severity: str, title: str, action: str, *text: Column | str) -> dict[str, Column]:
        parts = [F.lit(t) if isinstance(t, str) else t for t in text]
        return {
            "severity": F.lit(severity),
            "title": F.lit(title),
            "description": F.concat(*parts),
            "action": F.lit(action),
        }

    revenue, mrr, churn = F.col("revenue_change"), F.col("mrr_growth"), F.col("churn_rate")
    rules = [
        (churn > 10, alert(
            "high", "High Churn Rate", "Review customer feedback and renewal campaigns",
            _shortest(churn), "% monthly churn needs immediate attention")),
        (revenue < -10, alert(
            "high", "Revenue Decline", "Analyze sales pipeline and pricing strategy",
            "Revenue down ", _one_decimal(F.abs(revenue)), "% from previous period")),
        (mrr < -5, alert(
            "medium", "MRR Contraction", "Focus on upsells and renewals",
            "MRR declining ", _one_decimal(F.abs(mrr)), "%")),
    ]
    return _fired(periods, rules, None)
