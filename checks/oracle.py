"""Check queries: each registered report as one SQL statement for DuckDB.

They are written for clarity, not speed: plain joins, repeated rows really
built, correlated lookups, ranks by row number. That is what makes them a check
of the rewritten plans.
"""

from __future__ import annotations

import re

from tillwise.functions import fixed_values as fv
from tillwise.sources.sample_views import VIEWS, needs

DAY = "DATE '2001-08-02'"
PAID = "status IN ('complete', 'edd_subscription')"


def statement(body: str) -> str:
    """Prefix a body (``[extra AS (...), ] SELECT ...``) with the views it uses."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            for part in needs(name):
                visit(part)
            order.append(name)

    for name in re.findall(r"\bfx_\w+", body):
        visit(name)
    ctes = [f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v][1]).strip()})" for v in order]
    head = "WITH " + ",\n".join(ctes)
    body = body.strip()
    return f"{head}\n{body}" if body.upper().startswith("SELECT") else f"{head},\n{body}"


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


class Quotient(str):
    """A division as a DOUBLE, that remembers its parts."""

    above: str
    below: str


def div(a: str, b: str) -> Quotient:
    quotient = Quotient(f"({d(a)} / nullif({d(b)}, 0))")
    quotient.above, quotient.below = a, b
    return quotient


def plain(x: Quotient) -> str:
    """The DOUBLE, for parts that are no amounts or counts."""
    return str.__str__(x) + ""


def exact(a: str, b: str, digits: int = 2, factor: int = 1) -> str:
    """``factor * a / b`` in whole hundredths, rounded half away from zero."""
    above, below = (f"CAST(round(({x}) * 100) AS HUGEINT)" for x in (a, b))
    steps = f"((abs({above}) * {2 * factor * 10**digits} + abs({below})) // nullif(2 * abs({below}), 0))"
    return f"(CAST(CASE WHEN ({above} >= 0) = ({below} >= 0) THEN {steps} ELSE -{steps} END AS DOUBLE) / CAST({10**digits} AS DOUBLE))"


def r(x: str, digits: int = 2) -> str:
    """A ratio of amounts and counts exactly, anything else as the DOUBLE it is."""
    if isinstance(x, Quotient):
        return exact(x.above, x.below, digits)
    return f"round({d(x)} + 1e-9 * sign({d(x)}), {digits})"


def pct(a: str, b: str) -> str:
    return exact(a, b, 2, 100)


def pct_double(a: str, b: str) -> str:
    return r(f"CAST(100 AS DOUBLE) * {div(a, b)}")


def month(column: str) -> str:
    return f"strftime({column}, '%Y-%m-01') AS date, strftime({column}, '%B %Y') AS label"


def ago(n: int, unit: str) -> str:
    return f"({DAY} - INTERVAL {n} {unit})"


def between(column: str, start: str | None, end: str | None) -> str:
    text = ""
    if start:
        text += f" AND {column} >= TIMESTAMP '{start} 00:00:00'"
    if end:
        text += f" AND {column} <= TIMESTAMP '{end} 00:00:00'"
    return text


def chain(rules: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in rules) + f" ELSE '{otherwise}' END"


# ---- revenue ------------------------------------------------------------


def new_customers_by_month(start=None, end=None):
    return f"""SELECT {month('date_created')}, count(*) AS value FROM fx_customers
WHERE date_created IS NOT NULL{between('date_created', start, end)} GROUP BY 1, 2"""


def new_customers_yoy_change():
    return f"""c AS (SELECT year(date_created) AS y FROM fx_customers),
t AS (SELECT count(*) FILTER (WHERE y = year({DAY})) AS a, count(*) FILTER (WHERE y = year({DAY}) - 1) AS b FROM c)
SELECT a AS current_year, b AS last_year, coalesce({pct('a - b', 'b')}, 0) AS change FROM t"""


def revenue_by_month(start=None, end=None):
    return f"""SELECT {month('date_created')},
{d("coalesce(sum(total) FILTER (WHERE type = 'sale'), 0)")} AS new_revenue,
{d("coalesce(sum(total) FILTER (WHERE type = 'renewal'), 0)")} AS recurring_revenue,
{d('sum(total)')} AS total_revenue
FROM fx_orders WHERE {PAID} AND type IN ('sale', 'renewal'){between('date_created', start, end)} GROUP BY 1, 2"""


def refunded_revenue_by_month(start=None, end=None):
    return f"""SELECT {month('date_created')}, {d('abs(sum(total))')} AS value FROM fx_orders
WHERE status = 'refunded'{between('date_created', start, end)} GROUP BY 1, 2"""


def refund_rates_by_month(first=None, last=None):
    where = ""
    if first:
        where = f"WHERE strftime(date_created, '%Y-%m') BETWEEN '{first}' AND '{last}'"
    return f"""o AS (SELECT strftime(date_created, '%Y-%m') AS month_year, strftime(date_created, '%B %Y') AS label,
count(*) FILTER (WHERE status = 'refunded') AS a, count(*) FILTER (WHERE status IN ('complete', 'refunded')) AS b
FROM fx_orders {where} GROUP BY 1, 2)
SELECT month_year, label, coalesce({pct('a', 'b')}, 0) AS refund_rate FROM o"""


def new_customer_refund_rates_by_year(start=None, end=None):
    limits = between("date_created", start, end) or f" AND year(date_created) < year({DAY})"
    return f"""o AS (SELECT year(date_created) AS y, count(*) AS a, count(*) FILTER (WHERE status = 'refunded') AS b
FROM fx_orders WHERE parent = 0{limits} GROUP BY 1),
years AS (SELECT DISTINCT year(date_created) AS y FROM fx_orders WHERE TRUE{limits})
SELECT CAST(y AS INTEGER) AS year, coalesce(a, 0) AS new_orders, coalesce(b, 0) AS refunded_orders,
{pct('b', 'a')} AS refund_rate FROM years LEFT JOIN o USING (y)"""


def customer_engagement_metrics(start=None, end=None):
    return f"""SELECT {month('date_created')}, count(DISTINCT customer_id) AS active_customers,
count(DISTINCT id) AS total_orders, {r(div('sum(total)', 'count(total)'))} AS avg_order_value,
{r(div('count(DISTINCT id)', 'count(DISTINCT customer_id)'))} AS orders_per_customer
FROM fx_orders WHERE {PAID}{between('date_created', start, end)} GROUP BY 1, 2"""


_CODES = ", ".join(f"('{region}', '{code}')" for region, codes in fv.REGIONS for code in codes)
REGIONS = f"codes(region, code) AS (VALUES {_CODES})"


def revenue_by_region(start=None, end=None):
    return f"""{REGIONS},
lines AS (SELECT o.id, o.customer_id, o.total, coalesce(c.region, 'Other') AS region
FROM fx_orders o LEFT JOIN (SELECT * FROM fx_order_addresses WHERE type = 'billing') a ON a.order_id = o.id
LEFT JOIN codes c ON c.code = a.country WHERE o.{PAID}{between('o.date_created', start, end)})
SELECT region, count(DISTINCT id) AS order_count, count(DISTINCT customer_id) AS customer_count,
{d('sum(total)')} AS total_revenue, {r(div('sum(total)', 'count(total)'))} AS avg_order_value FROM lines GROUP BY region"""


def revenue_breakdown(start=None, end=None):
    def part(condition):
        return d(f"coalesce(sum(total) FILTER (WHERE {condition}), 0)")

    return f"""paid AS (SELECT * FROM fx_orders WHERE {PAID}),
h AS (SELECT p.id, count(q.id) AS n, count(q.total) AS known, sum(q.total) AS s FROM paid p
LEFT JOIN paid q ON q.customer_id = p.customer_id AND q.date_created < p.date_created GROUP BY p.id)
SELECT {month('date_created')}, {part("type = 'sale' AND n = 0")} AS new_customer_revenue,
{part("type = 'sale' AND n > 0")} AS existing_customer_revenue, {part("type = 'renewal'")} AS renewal_revenue,
{part("type = 'sale' AND n > 0 AND total * known > s")} AS upgrade_revenue, {d('sum(total)')} AS total_revenue
FROM paid JOIN h USING (id) WHERE TRUE{between('date_created', start, end)} GROUP BY 1, 2"""


def revenue_concentration():
    def top(name, source, value, k):
        return f"""SELECT '{name}' AS segment, {big('count(*)')} AS count, {d(f'sum({value})')} AS revenue,
{pct(f'sum({value})', f'(SELECT sum(total) FROM fx_orders WHERE {PAID})')} AS revenue_percentage
FROM (SELECT {value}, row_number() OVER (ORDER BY {value} DESC) AS place FROM {source}) x WHERE place <= {k}"""

    return f"""spent AS (SELECT c.id, sum(CASE WHEN o.{PAID} THEN o.total ELSE 0 END) AS v
FROM fx_customers c JOIN fx_orders o ON o.customer_id = c.id GROUP BY c.id),
sold AS (SELECT i.product_id, sum(i.total) AS v FROM fx_order_items i JOIN fx_orders o ON o.id = i.order_id
WHERE o.{PAID} GROUP BY i.product_id)
{top('Top 10% Customers', 'spent', 'v', '(SELECT count(*) // 10 FROM fx_customers)')}
UNION ALL
{top('Top 20% Customers', 'spent', 'v', '(SELECT count(*) // 5 FROM fx_customers)')}
UNION ALL
{top('Top 10% Products', 'sold', 'v', '(SELECT count(DISTINCT product_id) // 10 FROM fx_order_items)')}"""


def average_revenue_per_customer(start=None, end=None):
    return f"""SELECT {month('date_created')},
{r(div('sum(total)', 'count(DISTINCT customer_id)'))} AS avg_revenue_per_customer
FROM fx_orders WHERE {PAID}{between('date_created', start, end)} GROUP BY 1, 2"""


def payment_method_performance(start=None, end=None):
    ok = f"FILTER (WHERE {PAID})"
    return f"""SELECT coalesce(gateway, 'Unknown') AS payment_method, count(*) AS total_attempts,
count(*) {ok} AS successful_payments, count(*) FILTER (WHERE status = 'failed') AS failed_payments,
{pct(f'count(*) {ok}', 'count(*)')} AS success_rate, {d(f'coalesce(sum(total) {ok}, 0)')} AS total_revenue,
{r(div(f'sum(total) {ok}', f'count(total) {ok}'))} AS avg_transaction_value
FROM fx_orders WHERE TRUE{between('date_created', start, end)} GROUP BY 1"""


def failed_payment_recovery(start=None, end=None):
    return f"""pairs AS (SELECT f.id AS failed, f.date_created AS lost, p.id AS recovered, p.total,
datediff('day', f.date_created, p.date_created) AS days
FROM fx_orders f LEFT JOIN (SELECT * FROM fx_orders WHERE {PAID}) p ON p.customer_id = f.customer_id
AND p.date_created > f.date_created AND p.date_created <= f.date_created + INTERVAL 30 DAY
WHERE f.status = 'failed'{between('f.date_created', start, end)})
SELECT {month('lost')}, count(DISTINCT failed) AS failed_count, count(DISTINCT recovered) AS recovered_count,
{pct('count(DISTINCT recovered)', 'count(DISTINCT failed)')} AS recovery_rate,
{d('coalesce(sum(total), 0)')} AS recovered_revenue, {r(div('sum(days)', 'count(days)'), 1)} AS avg_days_to_recovery
FROM pairs GROUP BY 1, 2"""


def revenue_velocity(start=None, end=None):
    return f"""m AS (SELECT date_trunc('month', date_created) AS m, sum(total) AS v, row_number() OVER (ORDER BY date_trunc('month', date_created)) AS i
FROM fx_orders WHERE {PAID}{between('date_created', start, end)} GROUP BY 1)
SELECT {month('a.m')}, {d('a.v')} AS monthly_revenue, {d('b.v')} AS previous_month_revenue,
{d('a.v - b.v')} AS revenue_change, {pct('a.v - b.v', 'b.v')} AS growth_rate,
{d('a.v - 2 * b.v + c.v')} AS acceleration
FROM m a LEFT JOIN m b ON b.i = a.i - 1 LEFT JOIN m c ON c.i = a.i - 2"""


# ---- subscriptions ------------------------------------------------------


def mrr_by_month(start=None, end=None):
    return f"""SELECT {month('created')}, count(DISTINCT s.id) AS subscriptions, {r(div('sum(initial_amount)', '12'))} AS mrr
FROM fx_subscriptions s WHERE status <> 'pending'{between('created', start, end)}
AND coalesce(parent_payment_id NOT IN (SELECT id FROM fx_orders WHERE status = 'refunded'), TRUE)
AND coalesce(parent_payment_id NOT IN (SELECT parent FROM fx_orders WHERE status = 'refunded'), TRUE) GROUP BY 1, 2"""


def current_mrr_breakdown():
    def mrr(condition):
        return f"coalesce({r(div(f'sum(initial_amount) FILTER (WHERE {condition})', '12'))}, 0)"

    now = f"strftime({DAY}, '%Y-%m')"
    born, dies = "strftime(created, '%Y-%m')", "strftime(expiration, '%Y-%m')"
    ended = "status IN ('cancelled', 'expired')"
    return f"""t AS (SELECT {mrr(f"{born} = {now} AND status <> 'pending'")} AS a,
{mrr(f"{born} < {now} AND status = 'active'")} AS b, {mrr(f'{dies} = {now} AND {ended}')} AS c FROM fx_subscriptions)
SELECT a AS new_mrr, b AS existing_mrr, c AS churned_mrr, {r('a + b - c')} AS net_mrr FROM t"""


def renewal_rates_by_month(first_day=None, first=None, last=None):
    floor = f"date_created >= DATE '{first_day}' AND " if first_day else ""
    where = f"AND strftime(opens, '%Y-%m') BETWEEN '{first}' AND '{last}'" if first else ""
    return f"""c AS (SELECT id, date_created + INTERVAL 12 MONTH AS opens, date_created + INTERVAL 13 MONTH AS closes
FROM fx_customers WHERE {floor}date_created <= {ago(12, 'MONTH')}
AND (purchase_count <> 1 OR purchase_value < 847)),
f AS (SELECT c.id, opens, EXISTS (SELECT 1 FROM fx_orders o WHERE o.customer_id = c.id AND o.{PAID}
AND o.date_created >= opens AND o.date_created < closes) AS renewed FROM c WHERE TRUE {where})
SELECT strftime(opens, '%Y-%m') AS month_year, strftime(opens, '%B %Y') AS label,
{pct('count(*) FILTER (WHERE renewed)', 'count(*)')} AS renewal_rate FROM f GROUP BY 1, 2"""


def upcoming_renewals(days=30):
    return f"""SELECT count(*) AS count, {d('coalesce(sum(recurring_amount), 0)')} AS estimated_revenue FROM fx_subscriptions
WHERE status = 'active' AND expiration BETWEEN CAST({DAY} AS TIMESTAMP) AND {DAY} + INTERVAL {days} DAY"""


def top_licenses(limit=20):
    return f"""SELECT l.id AS license_id, l.license_key, count(a.site_name) AS activation_count,
any_value(p.post_title) AS download_name
FROM fx_licenses l LEFT JOIN fx_license_activations a ON a.license_id = l.id LEFT JOIN fx_posts p ON p.id = l.download_id
WHERE l.status <> 'disabled' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT {limit}"""


# ---- customers ----------------------------------------------------------

HISTORY = f"""hist AS (SELECT c.id AS customer_id, any_value(c.email) AS email, any_value(c.name) AS name,
max(o.date_created) AS last_order, CAST(datediff('day', max(o.date_created), {DAY}) AS INTEGER) AS days,
count(DISTINCT o.id) AS orders, sum(o.total) AS spent
FROM fx_customers c JOIN fx_orders o ON o.customer_id = c.id WHERE o.{PAID} GROUP BY c.id)"""


def customer_lifetime_values(start=None, end=None, limit=100):
    return f"""SELECT c.id AS customer_id, c.email, c.name, c.date_created AS signup_date,
count(DISTINCT o.id) AS purchase_count, {d(f'coalesce(sum(o.total) FILTER (WHERE o.{PAID}), 0)')} AS total_spent,
{r(div(f'sum(o.total) FILTER (WHERE o.{PAID})', f'count(o.total) FILTER (WHERE o.{PAID})'))} AS avg_order_value,
CAST(datediff('day', c.date_created, {DAY}) AS INTEGER) AS days_active, max(o.date_created) AS last_purchase_date
FROM fx_customers c JOIN fx_orders o ON o.customer_id = c.id WHERE c.date_created IS NOT NULL{between('c.date_created', start, end)}
GROUP BY 1, 2, 3, 4 ORDER BY 6 DESC, 1 LIMIT {limit}"""


def clv_by_cohort(start=None, end=None):
    return f"""t AS (SELECT c.id, c.date_created, datediff('day', c.date_created, {DAY}) AS age, count(o.id) AS n,
coalesce(sum(o.total) FILTER (WHERE o.{PAID}), 0) AS v FROM fx_customers c LEFT JOIN fx_orders o ON o.customer_id = c.id
WHERE c.date_created IS NOT NULL{between('c.date_created', start, end)} GROUP BY 1, 2, 3)
SELECT strftime(date_created, '%Y-%m-01') AS cohort_date, strftime(date_created, '%B %Y') AS cohort_label,
count(*) AS customer_count, {r(div('sum(v)', 'count(*)'))} AS avg_clv, {r(div('sum(n)', 'count(*)'))} AS avg_purchases,
{r(div('sum(age)', 'count(*)'), 0)} AS avg_days_active FROM t GROUP BY 1, 2"""


def clv_distribution():
    cuts = ", ".join(
        f"(SELECT v FROM s ORDER BY v OFFSET (SELECT count(*) * {q} // 100 FROM fx_customers) LIMIT 1) AS p{q}"
        for q in (90, 75, 50, 25)
    )
    label = chain([("v >= p90", "Top 10%"), ("v >= p75", "75-90%"), ("v >= p50", "50-75%"), ("v >= p25", "25-50%")], "Bottom 25%")
    return f"""s AS (SELECT c.id, coalesce(sum(o.total) FILTER (WHERE o.{PAID}), 0) AS v
FROM fx_customers c LEFT JOIN fx_orders o ON o.customer_id = c.id GROUP BY c.id), cuts AS (SELECT {cuts})
SELECT {label} AS segment, count(*) AS customer_count, {r(div('sum(v)', 'count(*)'))} AS avg_clv,
{d('sum(v)')} AS total_revenue FROM s, cuts WHERE v > 0 GROUP BY 1"""


SCORES = f"""{HISTORY},
rfm AS (SELECT *, CASE WHEN days <= 30 THEN 5 WHEN days <= 60 THEN 4 WHEN days <= 90 THEN 3 WHEN days <= 180 THEN 2 ELSE 1 END AS r,
CASE WHEN orders >= 10 THEN 5 WHEN orders >= 7 THEN 4 WHEN orders >= 4 THEN 3 WHEN orders >= 2 THEN 2 ELSE 1 END AS f,
CASE WHEN spent >= 5000 THEN 5 WHEN spent >= 2000 THEN 4 WHEN spent >= 1000 THEN 3 WHEN spent >= 500 THEN 2 ELSE 1 END AS m
FROM hist)"""
SEGMENT = chain(
    [
        ("r + f + m >= 13", "Champions"),
        ("r + f + m >= 10 AND r >= 4", "Loyal Customers"),
        ("m >= 4 AND r + f >= 6", "Big Spenders"),
        ("r >= 4 AND f <= 2", "Recent Customers"),
        ("f >= 4 AND r <= 2", "At Risk"),
        ("r <= 2 AND f <= 2", "Lost"),
    ],
    "Potential",
)


def rfm_segments():
    return f"""{SCORES}
SELECT customer_id, email, name, days AS recency_days, orders AS frequency, {d('spent')} AS monetary,
r AS recency_score, f AS frequency_score, m AS monetary_score FROM rfm"""


def segment_performance():
    return f"""{SCORES}
SELECT {SEGMENT} AS segment, count(*) AS customer_count, {d('sum(spent)')} AS total_revenue,
{r(div('sum(spent)', 'count(*)'))} AS avg_revenue, {r(div('sum(orders)', 'count(*)'))} AS avg_purchases,
{r(div('sum(days)', 'count(*)'), 0)} AS avg_days_since_purchase FROM rfm GROUP BY 1"""


def subs_of(alias: str, condition: str) -> str:
    return f"(SELECT count(*) FROM fx_subscriptions s WHERE s.customer_id = {alias}.customer_id AND {condition})"


def ended_since(bound: str) -> str:
    return f"s.status IN ('cancelled', 'expired') AND s.expiration >= {bound}"


def _health(limit):
    return f"""{HISTORY},
a AS (SELECT *, {subs_of('hist', "s.status = 'active'")} AS active FROM hist),
health AS (SELECT customer_id, email, name, days AS days_since_purchase, orders AS total_purchases, {d('spent')} AS total_spent,
active AS active_subscriptions,
{chain([('days <= 30 AND active > 0', 'Excellent'), ('days <= 60 AND orders >= 2', 'Good'), ('days <= 90', 'Fair'), ('days <= 180', 'At Risk')], 'Poor')} AS health_status,
CASE WHEN days <= 30 AND active > 0 THEN 95 WHEN days <= 60 AND orders >= 2 THEN 75 WHEN days <= 90 THEN 50 WHEN days <= 180 THEN 25 ELSE 10 END AS health_score
FROM a ORDER BY health_score DESC, total_spent DESC, customer_id LIMIT {limit})"""


def customer_health_scores(limit=100):
    return f"{_health(limit)}\nSELECT * FROM health"


def at_risk_customers(limit=50):
    return f"""{HISTORY},
a AS (SELECT *, {subs_of('hist', ended_since(ago(90, 'DAY')))} AS ended FROM hist),
b AS (SELECT *, CASE WHEN ended > 0 THEN 1 WHEN days > 120 AND orders >= 3 THEN 2 ELSE 3 END AS level FROM a
WHERE days > 90 AND orders >= 2 OR ended > 0)
SELECT customer_id, email, name, days AS days_since_purchase, orders AS total_purchases, {d('spent')} AS total_spent,
last_order AS last_purchase_date, ended AS recent_cancellations,
CASE level WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS churn_risk
FROM b ORDER BY level, spent DESC, customer_id LIMIT {limit}"""


def customer_acquisition_channels(start=None, end=None, dedupe=False):
    channel = chain(
        [(f"lower(content) LIKE '%{mark}%'", name) for mark, name in (
            ("utm_source=google", "Google"), ("utm_source=facebook", "Facebook"), ("utm_source=twitter", "Twitter"),
            ("utm_source=email", "Email"), ("utm_source=affiliate", "Affiliate"), ("referrer", "Referral"))],
        "Direct/Unknown",
    )
    # Notes are grouped first only because whole tables would give millions of equal rows.
    weight = "1" if dedupe else (
        "greatest((SELECT count(*) FROM fx_customermeta x WHERE x.customer_id = c.id), 1)"
        " * greatest((SELECT count(*) FROM fx_customer_email_addresses y WHERE y.customer_id = c.id), 1) * coalesce(n.n, 1)"
    )
    return f"""n AS (SELECT lower(comment_author_email) AS mail, {channel} AS channel, count(*) AS n FROM fx_comments
WHERE comment_type = 'edd_payment_note' GROUP BY 1, 2),
v AS (SELECT customer_id, coalesce(sum(total) FILTER (WHERE {PAID}), 0) AS spent FROM fx_orders GROUP BY 1),
t AS (SELECT c.id, coalesce(n.channel, 'Direct/Unknown') AS channel, v.spent, {weight} AS w
FROM fx_customers c LEFT JOIN n ON n.mail = lower(c.email) LEFT JOIN v ON v.customer_id = c.id
WHERE c.date_created IS NOT NULL{between('c.date_created', start, end)})
SELECT channel, count(DISTINCT id) AS customer_count, {d('sum(w * spent)')} AS total_revenue,
{r(div('sum(w * spent)', 'sum(w) FILTER (WHERE spent IS NOT NULL)'))} AS avg_revenue_per_customer FROM t GROUP BY 1"""


def time_to_first_purchase(start=None, end=None):
    label = chain([("n = 0", "Same Day"), ("n <= 1", "1 Day"), ("n <= 7", "2-7 Days"), ("n <= 30", "8-30 Days"), ("n <= 90", "31-90 Days")], "90+ Days")
    return f"""t AS (SELECT c.id, datediff('day', any_value(c.date_created), min(o.date_created)) AS n
FROM fx_customers c JOIN fx_orders o ON o.customer_id = c.id WHERE o.{PAID} AND c.date_created IS NOT NULL{between('c.date_created', start, end)}
GROUP BY c.id)
SELECT {label} AS time_segment, count(*) AS customer_count, {r(div('sum(n)', 'count(*)'), 1)} AS avg_days FROM t GROUP BY 1"""


def customer_activation_funnel(start=None, end=None):
    return f"""t AS (SELECT c.id, (SELECT count(*) FROM fx_orders o WHERE o.customer_id = c.id AND o.{PAID}) AS n,
(SELECT count(*) FROM fx_subscriptions s WHERE s.customer_id = c.id AND s.status <> 'pending') AS s
FROM fx_customers c WHERE c.date_created IS NOT NULL{between('c.date_created', start, end)}),
g AS (SELECT count(*) AS a, count(*) FILTER (WHERE n > 0) AS b, count(*) FILTER (WHERE n > 1) AS c, count(*) FILTER (WHERE s > 0) AS e FROM t)
SELECT a AS total_signups, b AS made_purchase, c AS repeat_purchase, e AS became_subscriber,
{pct('b', 'a')} AS purchase_rate, {pct('c', 'b')} AS repeat_rate, {pct('e', 'b')} AS subscription_rate FROM g"""


def customers_by_country(start=None, end=None, limit=20):
    return f"""SELECT coalesce(a.country, 'Unknown') AS country, count(DISTINCT c.id) AS customer_count,
count(DISTINCT o.id) AS total_orders, {d(f'coalesce(sum(o.total) FILTER (WHERE o.{PAID}), 0)')} AS total_revenue
FROM fx_customers c LEFT JOIN fx_orders o ON o.customer_id = c.id
LEFT JOIN (SELECT * FROM fx_order_addresses WHERE type = 'billing') a ON a.order_id = o.id
WHERE c.date_created IS NOT NULL{between('c.date_created', start, end)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}"""


# ---- products -----------------------------------------------------------


def sold(start=None, end=None, name="sold"):
    return f"""{name} AS (SELECT i.*, o.customer_id, o.date_created FROM fx_order_items i
JOIN fx_orders o ON o.id = i.order_id WHERE o.{PAID}{between('o.date_created', start, end)})"""


def _top_products(start=None, end=None, limit=20):
    return f"""{sold(start, end)},
best AS (SELECT product_id, any_value(post_title) AS product_name, count(DISTINCT order_id) AS order_count,
{big('sum(quantity)')} AS units_sold, {d('sum(s.total)')} AS total_revenue,
{r(plain(div(f"sum({div('s.total', 'quantity')})", f"count({div('s.total', 'quantity')})")))} AS avg_price,
{r(div('sum(s.total)', 'count(DISTINCT order_id)'))} AS aov
FROM sold s LEFT JOIN fx_posts p ON p.id = s.product_id GROUP BY product_id ORDER BY sum(s.total) DESC, product_id LIMIT {limit})"""


def top_products(start=None, end=None, limit=20):
    return f"{_top_products(start, end, limit)}\nSELECT * FROM best"


def product_growth_trends(start=None, end=None, limit=10):
    return f"""{sold(name='ever')}, {sold(start, end)},
top AS (SELECT product_id FROM ever GROUP BY 1 ORDER BY sum(total) DESC, 1 LIMIT {limit})
SELECT {month('date_created')}, product_id, any_value(post_title) AS product_name, {big('sum(quantity)')} AS units_sold,
{d('sum(s.total)')} AS revenue, count(DISTINCT order_id) AS order_count
FROM sold s JOIN top USING (product_id) LEFT JOIN fx_posts p ON p.id = s.product_id GROUP BY 1, 2, 3"""


def _matrix(start=None, end=None):
    now = f"date_created >= {ago(3, 'MONTH')}"
    old = f"date_created >= {ago(6, 'MONTH')} AND date_created < {ago(3, 'MONTH')}"
    sums = f"coalesce(sum(total) FILTER (WHERE {now}), 0) AS a, coalesce(sum(total) FILTER (WHERE {old}), 0) AS b"
    return f"""{sold(name='ever')}, {sold(start, end)},
growth AS (SELECT avg({div('a - b', 'b')} * 100) AS g FROM (SELECT product_id, {sums} FROM ever GROUP BY 1) x),
level AS (SELECT sum(v) AS v, count(*) AS n FROM (SELECT product_id, sum(total) AS v FROM ever WHERE {now} GROUP BY 1) x),
t AS (SELECT product_id, {sums}, sum(quantity) AS units FROM sold GROUP BY 1),
u AS (SELECT *, {pct('a - b', 'b')} AS rate FROM t WHERE a > 0),
matrix AS (SELECT product_id, post_title AS product_name, {d('a')} AS current_revenue, {d('b')} AS previous_revenue, rate AS growth_rate,
{big('units')} AS units_sold, CASE WHEN rate IS NULL THEN 'Dog' WHEN a * n >= v AND rate >= g THEN 'Star' WHEN a * n >= v THEN 'Cash Cow'
WHEN rate >= g THEN 'Question Mark' ELSE 'Dog' END AS quadrant
FROM u CROSS JOIN growth CROSS JOIN level LEFT JOIN fx_posts p ON p.id = u.product_id)"""


def product_performance_matrix(start=None, end=None):
    return f"{_matrix(start, end)}\nSELECT * FROM matrix"


def bundle_performance(start=None, end=None):
    return f"""{sold(start, end)},
lines AS (SELECT s.*, CASE WHEN p.post_parent > 0 OR m.meta_value IS NOT NULL THEN 'Bundle' ELSE 'Individual' END AS product_type
FROM sold s LEFT JOIN fx_posts p ON p.id = s.product_id
LEFT JOIN (SELECT * FROM fx_postmeta WHERE meta_key = '_edd_bundled_products') m ON m.post_id = p.id)
SELECT product_type, count(DISTINCT product_id) AS product_count, count(DISTINCT order_id) AS order_count,
{big('sum(quantity)')} AS units_sold, {d('sum(total)')} AS total_revenue, {r(div('sum(total)', 'count(total)'))} AS avg_revenue_per_sale,
{r(div('sum(total)', 'count(DISTINCT customer_id)'))} AS revenue_per_customer FROM lines GROUP BY 1"""


def product_lifecycle_stages(dedupe=False):
    now = f"s.date_created >= {ago(1, 'MONTH')}"
    old = f"s.date_created >= {ago(2, 'MONTH')} AND s.date_created < {ago(1, 'MONTH')}"
    stage = chain(
        [("months <= 3 AND trend > 20", "Introduction"), ("trend > 10", "Growth"), ("trend >= -10 AND trend <= 10", "Maturity"),
         ("trend < -10 AND trend >= -30", "Decline")], "End of Life")
    repeat = "" if dedupe else "JOIN monthly m ON m.product_id = s.product_id"
    return f"""{sold()},
monthly AS (SELECT product_id, strftime(date_created, '%Y-%m') AS ym, sum(total) AS v FROM sold GROUP BY 1, 2),
peaks AS (SELECT product_id, max(v) AS peak FROM monthly GROUP BY 1),
t AS (SELECT s.product_id, min(s.date_created) AS first, max(s.date_created) AS last,
coalesce(sum(s.total) FILTER (WHERE {now}), 0) AS a, coalesce(sum(s.total) FILTER (WHERE {old}), 0) AS b FROM sold s {repeat} GROUP BY 1),
u AS (SELECT *, datesub('month', first, CAST({DAY} AS TIMESTAMP)) AS months, {pct('a - b', 'b')} AS trend FROM t)
SELECT product_id, post_title AS product_name, {big('months')} AS months_active, trend AS revenue_trend, {d('a')} AS current_revenue,
{d('peak')} AS peak_revenue, {stage} AS lifecycle_stage, last AS last_sale_date
FROM u JOIN peaks USING (product_id) LEFT JOIN fx_posts p ON p.id = product_id WHERE months > 0"""


# ---- financial ----------------------------------------------------------


def cash_flow_projection(days=90):
    def each(expression):
        return ", ".join(f"{expression(n)} AS next_{n}_days" for n in (30, 60, 90))

    def due(n):
        return f"expiration <= {DAY} + INTERVAL {n} DAY"

    return f"""subs AS (SELECT *, customer_id IN (SELECT customer_id FROM fx_orders WHERE status = 'failed' AND customer_id IS NOT NULL
AND date_created >= {ago(60, 'DAY')}) AS shaky FROM fx_subscriptions WHERE status = 'active'),
sales AS (SELECT CAST(date_created AS DATE) AS day, sum(total) AS v FROM fx_orders WHERE {PAID} AND type = 'sale' GROUP BY 1)
SELECT 'Confirmed Revenue' AS category, {each(lambda n: d(f'sum(CASE WHEN {due(n)} THEN recurring_amount ELSE 0 END)'))}
FROM subs WHERE expiration >= {DAY} AND expiration <= {DAY} + INTERVAL {days} DAY
UNION ALL SELECT 'Projected New Sales', {each(lambda n: exact(f"sum(v) FILTER (WHERE day >= {ago(n, 'DAY')})", f"count(v) FILTER (WHERE day >= {ago(n, 'DAY')})", 2, n))} FROM sales
UNION ALL SELECT 'At-Risk Revenue', {each(lambda n: d(f'sum(CASE WHEN {due(n)} AND shaky THEN recurring_amount ELSE 0 END)'))} FROM subs"""


def profitability_by_segment(start=None, end=None):
    number = "coalesce(try_cast(nullif(regexp_extract(k.meta_value, '^[0-9]+[.]?[0-9]*'), '') AS DOUBLE), 0)"
    return f"""{sold(start, end)},
lines AS (SELECT s.total, s.quantity * {number} AS cost, CASE WHEN m.meta_value IS NULL THEN 'Individual' ELSE 'Bundle' END AS name
FROM sold s LEFT JOIN fx_posts p ON p.id = s.product_id
LEFT JOIN (SELECT * FROM fx_postmeta WHERE meta_key = '_edd_bundled_products') m ON m.post_id = p.id
LEFT JOIN (SELECT * FROM fx_postmeta WHERE meta_key = '_edd_product_cost') k ON k.post_id = p.id),
a AS (SELECT name, {d('sum(total)')} AS v, sum(cost) AS k FROM lines GROUP BY 1),
loyal AS (SELECT customer_id, CASE WHEN customer_id IS NULL THEN 'One-Time' WHEN count(*) >= 5 THEN 'Loyal' WHEN count(*) >= 2 THEN 'Repeat' ELSE 'One-Time' END AS name
FROM fx_orders WHERE {PAID} GROUP BY 1),
b AS (SELECT l.name, {d('sum(o.total)')} AS v FROM fx_orders o JOIN loyal l ON l.customer_id IS NOT DISTINCT FROM o.customer_id
WHERE o.{PAID}{between('o.date_created', start, end)} GROUP BY 1)
SELECT 'By Product Type' AS segment_type, name AS segment_name, v AS revenue, {r('k')} AS estimated_cost, {r('v - k')} AS gross_profit,
{pct_double('v - k', 'v')} AS profit_margin FROM a
UNION ALL SELECT 'By Customer Segment', name, v, {d('0')}, v, {d('100')} FROM b"""


def ltv_cac_ratio():
    year = f"date_created >= {ago(1, 'YEAR')}"
    return f"""s AS (SELECT c.id, coalesce(sum(o.total) FILTER (WHERE o.{PAID}), 0) AS v FROM fx_customers c
JOIN fx_orders o ON o.customer_id = c.id GROUP BY 1),
t AS (SELECT {div('sum(v)', 'count(*)')} AS ltv, count(*) AS n,
{div(f'(SELECT sum(total) FROM fx_orders WHERE {PAID} AND {year})', f'(SELECT count(*) FROM fx_customers WHERE {year})')} AS cac FROM s)
SELECT {r('ltv')} AS avg_ltv, {r(plain(div('ltv', 'cac')))} AS ltv_cac_ratio, round(cac, 6) AS estimated_cac, n AS customer_count FROM t"""


def revenue_run_rate():
    return f"""t AS (SELECT coalesce(sum(total) FILTER (WHERE date_created >= {ago(1, 'MONTH')}), 0) AS a,
coalesce(sum(total) FILTER (WHERE date_created >= {ago(3, 'MONTH')}), 0) AS b FROM fx_orders WHERE {PAID}),
s AS (SELECT sum(recurring_amount) AS m FROM fx_subscriptions WHERE status = 'active')
SELECT {d('a')} AS last_month_revenue, {r(d('a') + ' * 12')} AS annual_run_rate, {r(d('b') + ' / 3')} AS avg_monthly_revenue_3mo,
{r(d('b') + ' / 3 * 12')} AS annual_run_rate_3mo, {d('m * 12')} AS arr_from_subscriptions, {d('m')} AS mrr_from_subscriptions FROM t, s"""


def financial_health_indicators():
    one, two = ago(1, "MONTH"), ago(2, "MONTH")
    paid = f"FROM fx_orders WHERE {PAID}"

    def line(name, value, cuts, sign):
        grade = chain([(f"{value} {sign} {cut}", label) for cut, label in zip(cuts, ("Excellent", "Good", "Fair"))], "Poor")
        return f"SELECT '{name}' AS metric, {value} AS value, '%' AS unit, {grade} AS health_status FROM k"

    return f"""k AS (SELECT (SELECT sum(total) {paid} AND date_created >= {one}) AS a,
(SELECT sum(total) {paid} AND date_created >= {two} AND date_created < {one}) AS b,
(SELECT count(*) FROM fx_subscriptions WHERE status IN ('cancelled', 'expired') AND expiration >= {one}) AS c,
(SELECT count(*) FROM fx_subscriptions WHERE created < {one}) AS e,
(SELECT count(*) FROM (SELECT customer_id {paid} AND date_created >= {one} AND customer_id IS NOT NULL
 INTERSECT SELECT customer_id {paid} AND date_created < {one}) x) AS f,
(SELECT count(DISTINCT customer_id) {paid} AND date_created < {one}) AS g,
(SELECT count(*) FROM fx_orders WHERE status = 'refunded' AND date_created >= {one}) AS h,
(SELECT count(*) FROM fx_orders WHERE status IN ('complete', 'edd_subscription', 'refunded') AND date_created >= {one}) AS i)
{line('Revenue Growth', pct('a - b', 'b'), (10, 5, 0), '>=')}
UNION ALL {line('Churn Rate', pct('c', 'e'), (3, 5, 7), '<=')}
UNION ALL {line('Customer Retention', pct('f', 'g'), (80, 70, 60), '>=')}
UNION ALL {line('Refund Rate', pct('h', 'i'), (2, 5, 8), '<=')}"""


# ---- predictive ---------------------------------------------------------


def churn_prediction_scores(limit=100):
    since = ago(3, "MONTH")
    return f"""t AS (SELECT c.id AS customer_id, c.email, c.name, CAST(datediff('day', max(o.date_created), {DAY}) AS INTEGER) AS days, count(*) AS n,
coalesce(sum(o.total) FILTER (WHERE o.{PAID}), 0) AS v, count(*) FILTER (WHERE o.status = 'failed' AND o.date_created >= {since}) AS failures
FROM fx_customers c JOIN fx_orders o ON o.customer_id = c.id WHERE o.{PAID} OR o.status = 'failed' GROUP BY 1, 2, 3),
u AS (SELECT *, {subs_of('t', "s.status = 'active'")} AS active, {subs_of('t', ended_since(since))} AS ended FROM t),
w AS (SELECT *, CASE WHEN days > 180 OR failures >= 2 OR ended > 0 THEN 85 WHEN days > 90 OR failures >= 1 THEN 55 ELSE 20 END AS score FROM u)
SELECT customer_id, email, name, days AS days_since_last_order, n AS total_orders, {d('v')} AS lifetime_value, active AS active_subscriptions,
failures AS recent_failed_payments, CASE score WHEN 85 THEN 'High' WHEN 55 THEN 'Medium' ELSE 'Low' END AS churn_risk, score AS churn_score
FROM w ORDER BY score DESC, v DESC, customer_id LIMIT {limit}"""


def revenue_forecast(months=6):
    def estimate(rate):
        return r(f"mean * (1 + ({rate}) / 100)")

    return f"""m AS (SELECT date_trunc('month', date_created) AS m, sum(total) AS v FROM fx_orders WHERE {PAID} AND date_created >= {ago(12, 'MONTH')} GROUP BY 1),
g AS (SELECT v, {div('v - lag(v) OVER (ORDER BY m)', 'lag(v) OVER (ORDER BY m)')} * 100 AS g FROM m),
s AS (SELECT {div('sum(v)', 'count(*)')} AS mean, avg(g) AS rate, stddev_pop(g) AS spread, count(*) AS n FROM g)
SELECT strftime(date_trunc('month', {DAY}) + to_months(k), '%Y-%m-%d') AS forecast_date, strftime({DAY} + to_months(k), '%B %Y') AS forecast_label,
{estimate('rate')} AS projected_revenue, {estimate('rate - spread')} AS conservative_estimate, {estimate('rate + spread')} AS optimistic_estimate,
round(rate, 6) AS growth_rate, CASE WHEN n >= 12 THEN 'High' WHEN n >= 6 THEN 'Medium' ELSE 'Low' END AS confidence_level
FROM s, (SELECT CAST(unnest(range(1, {months} + 1)) AS INTEGER) AS k) x"""


def demand_forecast(days=30, limit=10):
    recent = f"day >= {ago(30, 'DAY')}"
    older = f"day >= {ago(60, 'DAY')} AND day < {ago(30, 'DAY')}"
    return f"""{sold()},
daily AS (SELECT product_id, CAST(date_created AS DATE) AS day, sum(quantity) AS q, sum(total) AS v FROM sold WHERE date_created >= {ago(90, 'DAY')} GROUP BY 1, 2),
t AS (SELECT product_id, sum(v) AS total, count(*) AS n, {div('sum(q)', 'count(*)')} AS units, {div('sum(v)', 'count(*)')} AS money,
{div(f'sum(q) FILTER (WHERE {recent})', f'count(*) FILTER (WHERE {recent})')} AS a, {div(f'sum(q) FILTER (WHERE {older})', f'count(*) FILTER (WHERE {older})')} AS b
FROM daily GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit})
SELECT product_id, post_title AS product_name, {r(f'units * {days}', 0)} AS forecasted_units, {r(f'money * {days}')} AS forecasted_revenue,
round(units, 6) AS avg_daily_sales, round(money, 6) AS avg_daily_revenue, CASE WHEN a > b THEN 'Increasing' WHEN a < b THEN 'Decreasing' ELSE 'Stable' END AS trend_direction,
CASE WHEN n >= 90 THEN 'High' WHEN n >= 30 THEN 'Medium' ELSE 'Low' END AS forecast_confidence FROM t LEFT JOIN fx_posts p ON p.id = t.product_id"""


def seasonal_patterns():
    season = chain(
        [("avg(v) >= any_value(w) * 1.2", "Peak Season"), ("avg(v) >= any_value(w) * 1.1", "High Season"),
         ("avg(v) >= any_value(w) * 0.9", "Normal Season"), ("avg(v) >= any_value(w) * 0.8", "Low Season")], "Off Season")
    return f"""m AS (SELECT date_trunc('month', date_created) AS m, {d('sum(total)')} AS v, count(*) AS n, count(DISTINCT customer_id) AS c
FROM fx_orders WHERE {PAID} AND date_created >= {ago(2, 'YEAR')} GROUP BY 1),
w AS (SELECT avg(v) AS w FROM m)
SELECT CAST(month(m) AS INTEGER) AS month_number, strftime(m, '%B') AS month_name, {r('avg(v)')} AS avg_revenue, {r('avg(n)', 0)} AS avg_orders,
{r('avg(c)', 0)} AS avg_customers, {r('stddev_pop(v)')} AS revenue_volatility, {pct_double('avg(v) - any_value(w)', 'any_value(w)')} AS deviation_from_average,
{season} AS seasonality_classification FROM m, w GROUP BY 1, 2"""


# ---- dashboard ----------------------------------------------------------


def _named(name: str, body: str) -> str:
    """A body as a CTE list that ends with the body's SELECT under ``name``."""
    if body.strip().upper().startswith("SELECT"):
        return f"{name} AS ({body})"
    ctes, select = body.rsplit("\nSELECT ", 1)
    return f"{ctes},\n{name} AS (SELECT {select})"


def mrr_growth():
    return f"""{_named('k', current_mrr_breakdown())}
SELECT round(100 * {div('new_mrr - churned_mrr', 'existing_mrr')}, 6) AS growth_rate, round(new_mrr - churned_mrr, 6) AS net_new_mrr FROM k"""


def average_renewal_rate(first_day, first, last):
    return f"""{_named('k', renewal_rates_by_month(first_day, first, last))}
SELECT round(avg(renewal_rate), 6) AS avg_renewal_rate FROM k"""


def refund_trailing_summary():
    return f"""{_named('k', refund_rates_by_month())},
{_named('v', refunded_revenue_by_month())},
k12 AS (SELECT *, row_number() OVER (ORDER BY month_year DESC) AS i FROM k QUALIFY i <= 12),
v12 AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS i FROM v QUALIFY i <= 12)
SELECT (SELECT round(avg(refund_rate), 6) FROM k12) AS avg_refund_rate, (SELECT refund_rate FROM k12 WHERE i = 1) AS last_refund_rate,
(SELECT round(sum(value), 6) FROM v12) AS refunded_revenue, (SELECT value FROM v12 WHERE i = 1) AS last_refunded_revenue"""


def customer_summary(limit):
    return f"""{_health(limit)}, clv AS ({customer_lifetime_values(limit=limit)}),
people AS (SELECT customer_id FROM hist UNION SELECT customer_id FROM clv)
SELECT (SELECT count(*) FROM people) AS total_customers, (SELECT round(avg(total_spent), 6) FROM clv) AS avg_clv,
(SELECT count(*) FROM health WHERE health_status ILIKE '%risk%') AS at_risk"""


def rfm_bucket_counts():
    names = ", ".join(f"('{n}')" for n in ("Champions", "Loyal Customers", "Big Spenders", "Recent Customers", "At Risk", "Lost", "Potential"))
    return f"""{SCORES}, names(segment) AS (VALUES {names}), t AS (SELECT {SEGMENT} AS segment FROM rfm)
SELECT n.segment, count(t.segment) AS customer_count FROM names n LEFT JOIN t ON t.segment = n.segment GROUP BY 1"""


def health_distribution(limit):
    return f"{_health(limit)}\nSELECT health_status, count(*) AS customer_count FROM health GROUP BY 1"


def top_clv_rows():
    return f"""clv AS ({customer_lifetime_values()})
SELECT customer_id AS id, CASE WHEN name IS NULL OR name = '' THEN email ELSE name END AS name, total_spent AS total,
coalesce(avg_order_value, 0) AS aov, purchase_count AS orders FROM clv"""


def product_summary():
    return f"""{_matrix()}
SELECT round(sum(current_revenue), 2) AS total_revenue, {big('sum(units_sold)')} AS total_units, round(avg(coalesce(growth_rate, 0)), 6) AS avg_growth,
count(*) FILTER (WHERE current_revenue > 0) AS active_products, round(sum(current_revenue) / sum(units_sold), 6) AS avg_aov FROM matrix"""


def product_search(term, limit, strong=True):
    return f"""{_top_products(limit=limit)},
f AS (SELECT * FROM best WHERE lower(coalesce(product_name, '')) LIKE '%{term}%')
SELECT * FROM f WHERE total_revenue {'>=' if strong else '<'} (SELECT avg(total_revenue) FROM f)"""


def product_search_with_growth(strong, rising):
    return f"""{_matrix()},
f AS (SELECT product_id, product_name, current_revenue AS total_revenue, growth_rate, units_sold FROM matrix),
m AS (SELECT avg(total_revenue) AS v, avg(coalesce(growth_rate, 0)) AS g FROM f)
SELECT f.* FROM f, m WHERE total_revenue {'>=' if strong else '<'} v AND coalesce(growth_rate, 0) {'>=' if rising else '<'} g"""


def bcg_quadrant():
    return f"""{_matrix()},
k AS (SELECT {div('sum(CAST(current_revenue AS DECIMAL(18,2)))', 'count(*)')} AS v, avg(coalesce(growth_rate, 0)) AS g FROM matrix)
SELECT product_id, product_name, current_revenue AS revenue, coalesce(growth_rate, 0) AS growth,
CASE WHEN current_revenue >= v THEN CASE WHEN coalesce(growth_rate, 0) >= g THEN 'Star' ELSE 'Cash Cow' END
WHEN coalesce(growth_rate, 0) >= g THEN 'Question Mark' ELSE 'Dog' END AS quadrant FROM matrix, k"""


def velocity_trend():
    return f"""{_named('k', revenue_velocity())}
SELECT date, growth_rate, CASE WHEN growth_rate > 5 THEN 'up' WHEN growth_rate < -5 THEN 'down' ELSE 'flat' END AS trend FROM k"""


def recurring_share():
    return f"""SELECT {d('sum(revenue)')} AS total, round(100 * {div("sum(revenue) FILTER (WHERE source = 'recurring')", 'sum(revenue)')}, 6) AS recurring_percentage,
{d('3')} AS velocity, 'good' AS health FROM fx_sources"""


def revenue_waterfall():
    def of(source):
        return f"(SELECT {d('sum(revenue)')} FROM fx_sources WHERE source = '{source}')"

    steps = [("Starting", of("starting")), ("New Sales", of("new")), ("Expansion", of("expansion")),
             ("Contraction", f"-abs({of('contraction')})"), ("Churn", f"-abs({of('churn')})"),
             ("Ending", f"round({of('starting')} + {of('new')} + {of('expansion')} - {of('contraction')} - {of('churn')}, 6)")]
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{name}' AS step, {value} AS value" for i, (name, value) in enumerate(steps, 1))


def revenue_by_source_share():
    return f"""s AS (SELECT source, {d('revenue')} AS v FROM fx_sources WHERE source IN ('new', 'recurring', 'expansion'))
SELECT upper(source[1]) || source[2:] AS name, v AS value, {r(f"100 * {div('v', '(SELECT sum(v) FROM s)')}")} AS share FROM s"""


def pareto():
    return f"""t AS (SELECT customer_id AS id, sum(total) AS revenue FROM fx_orders WHERE {PAID} AND customer_id IS NOT NULL GROUP BY 1),
u AS (SELECT *, sum(revenue) OVER (ORDER BY revenue DESC, id ROWS UNBOUNDED PRECEDING) AS upto, sum(revenue) OVER () AS whole FROM t)
SELECT id, {d('revenue')} AS revenue, {d('upto')} AS cumulative_revenue, {pct('upto', 'whole')} AS cumulative_percentage FROM u WHERE revenue IS NOT NULL"""


def cohort_heatmap():
    return f"""SELECT CAST(dense_rank() OVER (ORDER BY month_number) - 1 AS INTEGER) AS month_idx, CAST(dense_rank() OVER (ORDER BY cohort) - 1 AS INTEGER) AS cohort_idx,
{d('coalesce(revenue, 0)')} AS revenue, {d('max(revenue) OVER ()')} AS max_revenue FROM fx_cohorts"""


def latest_daily_revenue():
    return f"SELECT {d('revenue')} AS latest_revenue FROM fx_daily ORDER BY date DESC LIMIT 1"


def business_health_score():
    def part(level, change):
        return f"CASE WHEN {level} > 0 THEN least(coalesce({change}, 0) + 50, 100) ELSE 50 END"

    return f"""t AS (SELECT period, CAST(floor({part('total_revenue', 'revenue_change')} * CAST(0.35 AS DOUBLE)
+ greatest(100 - 10 * coalesce(churn_rate, 0), 0) * CAST(0.25 AS DOUBLE) + {part('current_mrr', 'mrr_growth')} * CAST(0.25 AS DOUBLE)
+ {part('new_customers', 'customer_change')} * CAST(0.15 AS DOUBLE) + CAST(0.5 AS DOUBLE) + 1e-9) AS INTEGER) AS s FROM fx_periods)
SELECT period, s AS health_score, CASE WHEN s = 0 THEN 'Loading...' WHEN s >= 80 THEN 'Excellent' WHEN s >= 60 THEN 'Good' WHEN s >= 40 THEN 'Needs Attention' ELSE 'Critical' END AS status FROM t"""


def tenth(x: str) -> str:
    return f"printf('%.1f', {r(x, 1)})"


def quick_wins():
    rules = [
        ("revenue_change > 10", "Strong Revenue Growth", f"'Revenue up ' || {tenth('revenue_change')} || '% vs previous period'"),
        ("mrr_growth > 5", "MRR Expanding", f"'MRR growing ' || {tenth('mrr_growth')} || '% month-over-month'"),
        ("coalesce(churn_rate, 0) < 5", "Low Churn Rate", f"'Customer retention at ' || {tenth('100 - coalesce(churn_rate, 0)')} || '%'"),
        ("new_customers > 50", "Customer Acquisition", "CAST(new_customers AS VARCHAR) || ' new customers this period'"),
    ]
    parts = [f"SELECT period, '{title}' AS title, {text} AS description FROM fx_periods WHERE {rule}" for rule, title, text in rules]
    none = " AND ".join(f"NOT coalesce({rule}, FALSE)" for rule, _, _ in rules)
    parts.append(f"SELECT period, 'Steady Performance', 'Continue monitoring key metrics for opportunities' FROM fx_periods WHERE {none}")
    return " UNION ALL ".join(parts)


def risk_alerts():
    return f"""SELECT period, 'high' AS severity, 'High Churn Rate' AS title,
CASE WHEN churn_rate = floor(churn_rate) THEN CAST(CAST(churn_rate AS BIGINT) AS VARCHAR) ELSE CAST(churn_rate AS VARCHAR) END
 || '% monthly churn needs immediate attention' AS description,
'Review customer feedback and renewal campaigns' AS action FROM fx_periods WHERE churn_rate > 10
UNION ALL SELECT period, 'high', 'Revenue Decline', 'Revenue down ' || {tenth('abs(revenue_change)')} || '% from previous period',
'Analyze sales pipeline and pricing strategy' FROM fx_periods WHERE revenue_change < -10
UNION ALL SELECT period, 'medium', 'MRR Contraction', 'MRR declining ' || {tenth('abs(mrr_growth)')} || '%', 'Focus on upsells and renewals' FROM fx_periods WHERE mrr_growth < -5"""


# ---- anonymisation ------------------------------------------------------


def _octet(key: str, n: int) -> str:
    return f"CAST(CAST('0x' || substr(md5('0:{n}:' || CAST({key} AS VARCHAR)), 1, 6) AS BIGINT) % 254 + 1 AS VARCHAR)"


def _address(key: str) -> str:
    return f"'192.168.' || {_octet(key, 1)} || '.' || {_octet(key, 2)}"


def anonymize_customers():
    return f"""SELECT id, 'anon_' || md5(email) || '@localhost.dev' AS email, CASE WHEN name IS NOT NULL THEN 'Customer_' || CAST(id AS VARCHAR) END AS name,
date_created, {big('purchase_count')} AS purchase_count, {d('purchase_value')} AS purchase_value FROM fx_customers"""


def anonymize_orders():
    return f"""SELECT id, {big('parent')} AS parent, customer_id, status, type, gateway, 'anon_' || md5(email) || '@localhost.dev' AS email,
{_address('id')} AS ip, {d('total')} AS total, date_created FROM fx_orders"""


def anonymize_customermeta():
    owner = "concat(coalesce(CAST(customer_id AS VARCHAR), ''), ':', meta_value)"
    return f"""SELECT customer_id, meta_key, CASE WHEN meta_key = '_edd_customer_ip' THEN {_address(owner)} ELSE meta_value END AS meta_value FROM fx_customermeta"""
