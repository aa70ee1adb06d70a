"""Registered queries: each report over the sample shop, with its check query.

``REGISTRY[name] = (build, sql)``: ``build(shop)`` gives the DataFrame, ``sql``
is the body of the check query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import oracle
from tillwise.functions.dates import preset_range
from tillwise.operators import OPERATORS, anonymize, dashboard
from tillwise.sources.sample_views import AS_OF, SampleShop

Build = Callable[[SampleShop], DataFrame]

# A range whose last day cuts at midnight, inside the data on both ends.
START, END = "1998-03-15", "2000-11-20"
MONTHS = ("1998-03", "2000-11")
COHORTS_FROM = "1994-01-01"

REGISTRY: dict[str, tuple[Build, str]] = {}


def portable(df: DataFrame, *unrounded: str) -> DataFrame:
    """Decimals as DOUBLE, and fixed digits for columns a report leaves unrounded."""
    columns = []
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        if field.name in unrounded:
            column = F.round(column, 6)
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _report(name: str, key: str | None = None, sql: str | None = None, unrounded: tuple[str, ...] = (), **params) -> None:
    def build(shop: SampleShop) -> DataFrame:
        return portable(OPERATORS[name](shop.store(), AS_OF, **params), *unrounded)

    REGISTRY[key or name] = (build, sql if sql is not None else getattr(oracle, name)())


def _derived(name: str, build: Build, sql: str, *unrounded: str) -> None:
    REGISTRY[name] = (lambda shop: portable(build(shop), *unrounded), sql)


RANGED = (
    "new_customers_by_month",
    "revenue_by_month",
    "refunded_revenue_by_month",
    "new_customer_refund_rates_by_year",
    "customer_engagement_metrics",
    "revenue_by_region",
    "revenue_breakdown",
    "average_revenue_per_customer",
    "payment_method_performance",
    "failed_payment_recovery",
    "revenue_velocity",
    "mrr_by_month",
    "customer_lifetime_values",
    "clv_by_cohort",
    "customer_acquisition_channels",
    "time_to_first_purchase",
    "customer_activation_funnel",
    "customers_by_country",
    "top_products",
    "product_growth_trends",
    "product_performance_matrix",
    "bundle_performance",
    "profitability_by_segment",
)
# Subscriptions and the six-month matrix have recent data only.
_RANGES = {"mrr_by_month": ("1999-06-10", "2001-03-05"), "product_performance_matrix": ("2001-01-15", "2001-07-20")}

_PLAIN = {
    "ltv_cac_ratio": ("estimated_cac",),
    "revenue_forecast": ("growth_rate",),
    "demand_forecast": ("avg_daily_sales", "avg_daily_revenue"),
}
for _name in OPERATORS:
    _report(_name, unrounded=_PLAIN.get(_name, ()))
for _name in RANGED:
    _start, _end = _RANGES.get(_name, (START, END))
    _report(_name, f"{_name}_ranged", getattr(oracle, _name)(_start, _end), start=_start, end=_end)

_report("renewal_rates_by_month", "renewal_rates_by_month_from_1994", oracle.renewal_rates_by_month(COHORTS_FROM),
        cohort_first_day=COHORTS_FROM)
_report(
    "renewal_rates_by_month", "renewal_rates_by_month_ranged",
    oracle.renewal_rates_by_month(COHORTS_FROM, *MONTHS), start=START, end=END, cohort_first_day=COHORTS_FROM,
)
_report(
    "refund_rates_by_month", "refund_rates_by_month_ranged", oracle.refund_rates_by_month(*MONTHS),
    start=START, end=END,
)
_report("customer_acquisition_channels", "customer_acquisition_channels_dedupe",
        oracle.customer_acquisition_channels(dedupe=True), dedupe=True)
_report("product_lifecycle_stages", "product_lifecycle_stages_dedupe",
        oracle.product_lifecycle_stages(dedupe=True), dedupe=True)
# All products and customers instead of the best few.
for _name in ("top_products", "top_licenses", "customers_by_country", "product_growth_trends", "customer_lifetime_values", "customer_health_scores", "at_risk_customers",
              "churn_prediction_scores", "demand_forecast"):
    _report(_name, f"{_name}_all", getattr(oracle, _name)(limit=10**9), _PLAIN.get(_name, ()), limit=None)

# Horizons other than the defaults.
_report("revenue_forecast", "revenue_forecast_12_months", oracle.revenue_forecast(12), _PLAIN["revenue_forecast"], months=12)
_report("demand_forecast", "demand_forecast_7_days", oracle.demand_forecast(7), _PLAIN["demand_forecast"], days=7)
_report("upcoming_renewals", "upcoming_renewals_100_days", oracle.upcoming_renewals(100), days=100)
_report("cash_flow_projection", "cash_flow_projection_45_days", oracle.cash_flow_projection(45), days=45)

# The range presets, each on a series.
_YEAR_START, _YEAR_END = (str(day) for day in preset_range("365", AS_OF))
for _preset in ("30", "90", "365", "ytd"):
    _start, _end = (str(day) for day in preset_range(_preset, AS_OF))
    _report("revenue_by_month", f"revenue_by_month_preset_{_preset}", oracle.revenue_by_month(_start, _end),
            start=_start, end=_end)


def _run(shop: SampleShop, name: str, **params) -> DataFrame:
    return OPERATORS[name](shop.store(), AS_OF, **params)


def _renewals(shop: SampleShop, **params) -> DataFrame:
    return _run(shop, "renewal_rates_by_month", cohort_first_day=COHORTS_FROM, **params)


_derived("mrr_growth", lambda s: dashboard.mrr_growth(_run(s, "current_mrr_breakdown")), oracle.mrr_growth(),
         "growth_rate", "net_new_mrr")
_derived("average_renewal_rate",
         lambda s: dashboard.average_renewal_rate(_renewals(s, start=START, end=END), _renewals(s)),
         oracle.average_renewal_rate(COHORTS_FROM, *MONTHS), "avg_renewal_rate")
_derived("average_renewal_rate_fallback",
         lambda s: dashboard.average_renewal_rate(_renewals(s, start="1980-01-01", end="1980-12-31"), _renewals(s)),
         oracle.average_renewal_rate(COHORTS_FROM, None, None), "avg_renewal_rate")
_derived("refund_trailing_summary",
         lambda s: dashboard.refund_trailing_summary(
             _run(s, "refund_rates_by_month"), _run(s, "refunded_revenue_by_month")),
         oracle.refund_trailing_summary(), "avg_refund_rate", "refunded_revenue")
_derived("customer_summary",
         lambda s: dashboard.customer_summary(
             _run(s, "customer_lifetime_values", limit=None), _run(s, "rfm_segments"),
             _run(s, "customer_health_scores", limit=None)),
         oracle.customer_summary(10**9), "avg_clv")
_derived("rfm_bucket_counts", lambda s: dashboard.rfm_bucket_counts(_run(s, "rfm_segments")),
         oracle.rfm_bucket_counts())
_derived("health_distribution",
         lambda s: dashboard.health_distribution(_run(s, "customer_health_scores", limit=None)),
         oracle.health_distribution(10**9))
_derived("top_clv_rows", lambda s: dashboard.top_clv_rows(_run(s, "customer_lifetime_values")),
         oracle.top_clv_rows())
_derived("product_summary", lambda s: dashboard.product_summary(_run(s, "product_performance_matrix")),
         oracle.product_summary(), "avg_growth", "avg_aov")
_derived("product_search",
         lambda s: dashboard.product_search(
             _run(s, "top_products", limit=None), "BOLT", "stars", "total_revenue", descending=False),
         oracle.product_search("bolt", 10**9))
_derived("product_search_question_marks",
         lambda s: dashboard.product_search(
             _run(s, "top_products", limit=None), "bolt", "question-marks", "units_sold"),
         oracle.product_search("bolt", 10**9, strong=False))


def _matrix_as_products(shop: SampleShop) -> DataFrame:
    return _run(shop, "product_performance_matrix").withColumnRenamed("current_revenue", "total_revenue").drop(
        "previous_revenue", "quadrant"
    )


for _name, _strong, _rising in (("stars", True, True), ("cash_cows", True, False), ("dogs", False, False)):
    _derived(f"product_search_{_name}_by_growth",
             lambda s, name=_name: dashboard.product_search(
                 _matrix_as_products(s), "", name.replace("_", "-"), "growth_rate", descending=name != "dogs"),
             oracle.product_search_with_growth(_strong, _rising))
_derived("bcg_quadrant", lambda s: dashboard.bcg_quadrant(_run(s, "product_performance_matrix")),
         oracle.bcg_quadrant())
# A range without sales falls back to all time.
_derived("bcg_quadrant_all_time",
         lambda s: dashboard.bcg_quadrant(
             _run(s, "product_performance_matrix", start="1980-01-01", end="1980-12-31"), _run(s, "product_performance_matrix")),
         oracle.bcg_quadrant())
_derived("product_summary_all_time",
         lambda s: dashboard.product_summary(
             _run(s, "product_performance_matrix", start="1980-01-01", end="1980-12-31"), _run(s, "product_performance_matrix")),
         oracle.product_summary(), "avg_growth", "avg_aov")
_derived("velocity_trend",
         lambda s: dashboard.with_trend_class(_run(s, "revenue_velocity")).select("date", "growth_rate", "trend"),
         oracle.velocity_trend())
_derived("recurring_share", lambda s: dashboard.recurring_share(s.frame("fx_sources"), 3.0),
         oracle.recurring_share(), "recurring_percentage")
_derived("revenue_waterfall", lambda s: dashboard.revenue_waterfall(s.frame("fx_sources")),
         oracle.revenue_waterfall(), "value")
_derived("revenue_by_source_share", lambda s: dashboard.revenue_by_source_share(s.frame("fx_sources")),
         oracle.revenue_by_source_share())


def _pareto(shop: SampleShop) -> DataFrame:
    """Customers by revenue."""
    spent = (
        shop.store().orders.filter(F.col("status").isin("complete", "edd_subscription"))
        .filter(F.col("customer_id").isNotNull())
        .groupBy(F.col("customer_id").alias("id")).agg(F.sum("total").alias("revenue"))
    )
    return dashboard.pareto(spent)


_derived("pareto", _pareto, oracle.pareto())
_derived("cohort_heatmap", lambda s: dashboard.cohort_heatmap(s.frame("fx_cohorts")), oracle.cohort_heatmap())
_derived("latest_daily_revenue", lambda s: dashboard.latest_daily_revenue(s.frame("fx_daily")),
         oracle.latest_daily_revenue())
_derived("business_health_score", lambda s: dashboard.business_health_score(s.frame("fx_periods")),
         oracle.business_health_score())
_derived("quick_wins", lambda s: dashboard.quick_wins(s.frame("fx_periods")), oracle.quick_wins())
_derived("risk_alerts", lambda s: dashboard.risk_alerts(s.frame("fx_periods")), oracle.risk_alerts())

_derived("anonymize_customers", lambda s: anonymize.anonymize(s.store()).customers, oracle.anonymize_customers())
_derived("anonymize_orders", lambda s: anonymize.anonymize(s.store()).orders, oracle.anonymize_orders())
_derived("anonymize_customermeta", lambda s: anonymize.anonymize(s.store()).customermeta,
         oracle.anonymize_customermeta())
