"""The driver's tables seen as a shop.

There is no shop data to test with, so the tables of TESTDATA.md are mapped to
the store schema. Every mapping reads its whole table: irregular cases
(customers without orders, guest orders, products without a title, repeated
attribute rows) come from mapped values, never from leaving rows out.

The texts are valid in Spark SQL and in DuckDB alike, so that a check query can
see the very same shop. ``{name}`` stands for a table or for an earlier view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tillwise.sources.store import Store

AS_OF = "2001-08-02"

_PAID = "('complete', 'edd_subscription')"
_CENTS = "CAST(0.01 AS DECIMAL(3,2))"

# view name -> (store table or None, SQL)
VIEWS: dict[str, tuple[str | None, str]] = {
    "iso": (
        None,
        """
SELECT n_nationkey AS nk, CASE n_nationkey
 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'GB' WHEN 3 THEN 'DE' WHEN 4 THEN 'FR' WHEN 5 THEN 'AU'
 WHEN 6 THEN 'SG' WHEN 7 THEN 'BR' WHEN 8 THEN 'AR' WHEN 9 THEN 'IN' WHEN 10 THEN 'PK' WHEN 11 THEN 'CN'
 WHEN 12 THEN 'JP' WHEN 13 THEN 'ZA' WHEN 14 THEN 'EG' WHEN 15 THEN 'AE' WHEN 16 THEN 'TR' WHEN 17 THEN 'MX'
 WHEN 18 THEN 'NL' WHEN 19 THEN 'SE' WHEN 20 THEN 'NZ' WHEN 21 THEN 'CL' WHEN 22 THEN 'KR' WHEN 23 THEN 'RU'
 END AS country FROM {nation}""",
    ),
    "fx_orders": (
        "orders",
        f"""
SELECT o_orderkey AS id,
 CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey - 1 ELSE 0 END AS parent,
 CASE WHEN o_custkey % 25 = 0 THEN NULL ELSE o_custkey END AS customer_id,
 CASE WHEN o_orderkey % 20 < 12 THEN 'complete' WHEN o_orderkey % 20 < 16 THEN 'edd_subscription'
  WHEN o_orderkey % 20 = 16 THEN 'refunded' WHEN o_orderkey % 20 < 19 THEN 'failed' ELSE 'pending' END AS status,
 CASE WHEN o_orderkey % 3 = 0 THEN 'renewal' ELSE 'sale' END AS type,
 CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS gateway,
 concat('c', CAST(o_custkey AS STRING), '@shop.test') AS email,
 concat('10.0.', CAST(o_orderkey % 256 AS STRING), '.1') AS ip,
 CASE WHEN o_orderkey % 43 = 5 THEN NULL ELSE CAST(CAST(floor(o_totalprice
  / CASE o_custkey % 10 WHEN 0 THEN 4 WHEN 1 THEN 40 ELSE 10 END) AS BIGINT) * {_CENTS} AS DECIMAL(18,2)) END AS total,
 CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 86400) * INTERVAL '1' SECOND AS date_created
 FROM {{orders}}""",
    ),
    "fx_customers": (
        "customers",
        f"""
SELECT c_custkey AS id, concat('c', CAST(c_custkey AS STRING), '@shop.test') AS email, c_name AS name,
 CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN d IS NULL THEN TIMESTAMP '2001-07-10 06:00:00'
  WHEN c_custkey % 31 = 0 THEN d + INTERVAL '3' DAY
  ELSE d - (CASE c_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 20 WHEN 4 THEN 60 ELSE 200 END)
   * INTERVAL '1' DAY END AS date_created,
 CASE WHEN c_custkey % 40 = 1 THEN 1 ELSE coalesce(n, 0) END AS purchase_count,
 CASE WHEN c_custkey % 40 = 1 THEN CAST(900 AS DECIMAL(18,2)) ELSE CAST(coalesce(v, 0) AS DECIMAL(18,2)) END
  AS purchase_value
 FROM {{customer}} LEFT JOIN (SELECT customer_id, count(*) AS n, sum(total) AS v, min(date_created) AS d
  FROM {{fx_orders}} WHERE status IN {_PAID} GROUP BY customer_id) p ON c_custkey = p.customer_id""",
    ),
    "fx_subscriptions": (
        "subscriptions",
        """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 ELSE c_custkey END AS customer_id,
 m AS parent_payment_id,
 CASE WHEN c_custkey % 5 < 2 THEN 'active' WHEN c_custkey % 5 = 2 THEN 'cancelled' WHEN c_custkey % 5 = 3 THEN 'expired'
  ELSE 'pending' END AS status,
 CASE WHEN c_custkey % 37 = 11 THEN NULL ELSE CAST(10 + c_custkey % 90 + 0.99 AS DECIMAL(18,2)) END AS initial_amount,
 CASE WHEN c_custkey % 41 = 12 THEN NULL ELSE CAST(8 + c_custkey % 70 + 0.49 AS DECIMAL(18,2)) END AS recurring_amount,
 TIMESTAMP '2001-08-02 09:00:00' - (c_custkey * 11 % 900) * INTERVAL '1' DAY AS created,
 TIMESTAMP '2001-08-02 12:00:00' + (c_custkey * 13 % 400 - 200) * INTERVAL '1' DAY AS expiration
 FROM {customer} LEFT JOIN (SELECT customer_id, min(id) AS m FROM {fx_orders} GROUP BY customer_id) f
  ON c_custkey = f.customer_id""",
    ),
    "fx_order_items": (
        "order_items",
        f"""
SELECT l_orderkey AS order_id,
 CASE WHEN l_partkey % 53 = 39 THEN l_partkey + 1000000000 ELSE l_partkey END AS product_id,
 CAST(l_quantity AS INT) AS quantity,
 CAST(CAST(floor(l_extendedprice * (1 - l_discount) / 10) AS BIGINT) * {_CENTS} AS DECIMAL(18,2)) AS total
 FROM {{lineitem}}""",
    ),
    "fx_posts": (
        "products",
        """
SELECT p_partkey AS id, p_name AS post_title, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS post_parent
 FROM {part}""",
    ),
    "fx_postmeta": (
        "product_meta",
        """
SELECT p_partkey AS post_id, CASE WHEN p_partkey % 5 = 0 THEN '_edd_bundled_products' ELSE '_sku' END AS meta_key,
 CASE WHEN p_partkey % 45 = 0 THEN NULL ELSE '1,2' END AS meta_value FROM {part}
UNION ALL
SELECT p_partkey, CASE WHEN p_partkey % 35 = 0 THEN '_edd_bundled_products' ELSE '_views' END, '3' FROM {part}
UNION ALL
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '_edd_product_cost' ELSE '_weight' END,
 CASE WHEN p_partkey % 22 = 2 THEN '12abc' WHEN p_partkey % 22 = 4 THEN 'n/a'
  ELSE CAST(CAST(p_partkey % 60 AS DECIMAL(9,2)) AS STRING) END FROM {part}
UNION ALL
SELECT p_partkey, CASE WHEN p_partkey % 26 = 0 THEN '_edd_product_cost' ELSE '_color' END, '1.5' FROM {part}""",
    ),
    "fx_order_addresses": (
        "order_addresses",
        """
SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 11 = 0 THEN 'shipping' ELSE 'billing' END AS type, country
 FROM {orders} JOIN {customer} ON o_custkey = c_custkey LEFT JOIN {iso} ON c_nationkey = nk
UNION ALL
SELECT o_orderkey - o_orderkey % 9, CASE WHEN o_orderkey % 13 = 0 THEN 'billing' ELSE 'shipping' END, 'JP' FROM {orders}""",
    ),
    "fx_comments": (
        "notes",
        """
SELECT concat('C', CAST(user_id AS STRING), '@Shop.test') AS comment_author_email,
 CASE WHEN event_id % 7 = 0 THEN 'comment' ELSE 'edd_payment_note' END AS comment_type,
 CASE event_type WHEN 'click' THEN 'lp?utm_source=google' WHEN 'view' THEN 'lp?utm_source=facebook'
  WHEN 'purchase' THEN 'UTM_SOURCE=EMAIL' WHEN 'signup' THEN 'referrer: blog' ELSE 'plain' END AS content
 FROM {events}""",
    ),
    "fx_licenses": (
        "licenses",
        """
SELECT o_orderkey AS id, concat('KEY-', CAST(o_orderkey AS STRING)) AS license_key, o_custkey AS download_id,
 CASE WHEN o_orderkey % 30 = 0 THEN 'disabled' ELSE 'active' END AS status FROM {orders}""",
    ),
    "fx_license_activations": (
        "license_activations",
        """
SELECT l_orderkey AS license_id,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('site', CAST(l_linenumber AS STRING), '.test') END AS site_name
 FROM {lineitem}""",
    ),
    "fx_customermeta": (
        "customermeta",
        """
SELECT CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 ELSE c_custkey END AS customer_id,
 CASE WHEN c_custkey % 4 = 0 THEN '_edd_customer_ip' ELSE 'locale' END AS meta_key,
 concat('10.1.', CAST(c_custkey % 256 AS STRING), '.1') AS meta_value FROM {customer}
UNION ALL
SELECT c_custkey - c_custkey % 4, 'note_count', '1' FROM {customer}""",
    ),
    "fx_customer_email_addresses": (
        "customer_email_addresses",
        """
SELECT c_custkey AS customer_id FROM {customer}
UNION ALL
SELECT c_custkey - c_custkey % 10 FROM {customer}""",
    ),
    # Inputs of the dashboard summaries that no report supplies.
    "fx_sources": (
        None,
        """
SELECT source, sum(total) AS revenue FROM (SELECT total, CASE WHEN status = 'pending' THEN 'starting'
 WHEN status = 'refunded' THEN 'churn' WHEN status = 'failed' THEN 'contraction'
 WHEN status = 'edd_subscription' THEN 'expansion' WHEN type = 'renewal' THEN 'recurring' ELSE 'new' END AS source
 FROM {fx_orders}) o GROUP BY source""",
    ),
    "fx_daily": (
        None,
        f"""
SELECT CAST(date_created AS DATE) AS date, sum(total) AS revenue FROM {{fx_orders}} WHERE status IN {_PAID}
 GROUP BY CAST(date_created AS DATE)""",
    ),
    "fx_cohorts": (
        None,
        f"""
SELECT CAST(CAST(date_trunc('month', c.date_created) AS DATE) AS STRING) AS cohort,
 (year(o.date_created) - year(c.date_created)) * 12 + month(o.date_created) - month(c.date_created) AS month_number,
 sum(o.total) AS revenue
 FROM {{fx_orders}} o JOIN {{fx_customers}} c ON o.customer_id = c.id
 WHERE o.status IN {_PAID} AND c.date_created IS NOT NULL
 GROUP BY 1, 2""",
    ),
    "fx_periods": (
        None,
        f"""
SELECT CAST(CAST(r.m AS DATE) AS STRING) AS period, CAST(r.v AS DOUBLE) AS total_revenue,
 CAST(r.v - lag(r.v) OVER (ORDER BY r.m) AS DOUBLE) * 100 / CAST(nullif(lag(r.v) OVER (ORDER BY r.m), 0) AS DOUBLE)
  AS revenue_change,
 CAST(e.ended AS DOUBLE) * 100 / CAST(nullif(e.due, 0) AS DOUBLE) AS churn_rate,
 CAST(s.v AS DOUBLE) / 12 AS current_mrr,
 CAST(s.v - lag(s.v) OVER (ORDER BY r.m) AS DOUBLE) * 100 / CAST(nullif(lag(s.v) OVER (ORDER BY r.m), 0) AS DOUBLE)
  AS mrr_growth,
 c.n AS new_customers,
 CAST(c.n - lag(c.n) OVER (ORDER BY r.m) AS DOUBLE) * 100 / CAST(nullif(lag(c.n) OVER (ORDER BY r.m), 0) AS DOUBLE)
  AS customer_change
 FROM (SELECT date_trunc('month', date_created) AS m, sum(total) AS v FROM {{fx_orders}} WHERE status IN {_PAID}
  GROUP BY 1) r
 LEFT JOIN (SELECT date_trunc('month', created) AS m, sum(initial_amount) AS v FROM {{fx_subscriptions}} GROUP BY 1) s
  ON r.m = s.m
 LEFT JOIN (SELECT date_trunc('month', expiration) AS m, count(*) AS due,
  sum(CASE WHEN status IN ('cancelled', 'expired') THEN 1 ELSE 0 END) AS ended FROM {{fx_subscriptions}} GROUP BY 1) e
  ON r.m = e.m
 LEFT JOIN (SELECT date_trunc('month', date_created) AS m, count(*) AS n FROM {{fx_customers}} GROUP BY 1) c
  ON r.m = c.m""",
    ),
}

_NAME = re.compile(r"\{(\w+)\}")


def needs(view: str) -> list[str]:
    """Names a view refers to, tables and views alike."""
    return sorted(set(_NAME.findall(VIEWS[view][1])))


class SampleShop:
    """The sample views over one directory of driver tables."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory
        self._frames: dict[str, DataFrame] = {}

    def frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in VIEWS:
                inputs = {part: self.frame(part) for part in needs(name)}
                self._frames[name] = self.spark.sql(VIEWS[name][1], **inputs)
            else:
                self._frames[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        return self._frames[name]

    def store(self) -> Store:
        view_of = {table: view for view, (table, _) in VIEWS.items() if table}
        return Store(self.spark, lambda table: self.frame(view_of[table]))
