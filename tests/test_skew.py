"""Skewed inputs against brute force: the split plans must give the plain results."""

from __future__ import annotations

import datetime as dt
import random
import re
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import order, rows_of
from tillwise.operators import dashboard
from tillwise.operators.revenue import failed_payment_recovery, revenue_breakdown
from tillwise.plans import sales
from tillwise.plans.prefix import running_before, value_counts, value_ranks
from tillwise.plans.ranges import label_places, ranged
from tillwise.sources.sample_views import AS_OF

DAY = dt.timedelta(days=1)


@pytest.fixture(scope="module")
def busy(make_store):
    """Customer 1 owns a third of all orders, many at the same second; some orders have no customer."""
    rng = random.Random(7)
    begin = dt.datetime(2000, 1, 15)
    orders = []
    for i in range(1800):
        who = 1 if i % 3 == 0 else rng.choice([None, *range(2, 40)])
        when = begin + rng.randrange(120) * DAY + rng.choice([0, 0, 5, 43_200]) * dt.timedelta(seconds=1)
        status = rng.choice(["complete", "complete", "edd_subscription", "failed", "failed", "refunded"])
        orders.append(
            order(i, who, when.isoformat(), rng.choice([5, 5, 20, 33.33]), status, rng.choice(["sale", "sale", "renewal"]))
        )
    return make_store(orders=orders), orders


def _months(orders):
    return [(dt.datetime.fromisoformat(o["date_created"]), o) for o in orders]


def test_recovery_equals_all_pairs(busy):
    store, orders = busy
    dated = _months(orders)
    failed, pairs, revenue, days, recovered = (defaultdict(int), defaultdict(int), defaultdict(Decimal), defaultdict(int), defaultdict(set))
    paid = defaultdict(list)
    for when, o in dated:
        if o["status"] in ("complete", "edd_subscription"):
            paid[o["customer_id"]].append((when, o))
    for when, o in dated:
        if o["status"] != "failed":
            continue
        month = when.strftime("%Y-%m-01")
        failed[month] += 1
        for later, p in paid[o["customer_id"]] if o["customer_id"] else ():
            if when < later <= when + 30 * DAY:
                pairs[month] += 1
                revenue[month] += Decimal(str(p["total"]))
                days[month] += (later.date() - when.date()).days
                recovered[month].add(p["id"])
    found = {r["date"]: r for r in rows_of(failed_payment_recovery(store, AS_OF))}
    assert {m: r["failed_count"] for m, r in found.items()} == dict(failed)
    for month, row in found.items():
        assert row["recovered_count"] == len(recovered[month])
        assert row["recovered_revenue"] == revenue[month]
        assert row["avg_days_to_recovery"] == pytest.approx(days[month] / pairs[month], abs=0.051)
        assert row["recovery_rate"] == pytest.approx(100 * len(recovered[month]) / failed[month], abs=0.0051)


def test_recovery_window_can_touch_three_months(make_store):
    store = make_store(orders=[
        order(1, 1, "2001-01-31T10:00:00", status="failed"),
        order(2, 1, "2001-02-10T10:00:00", status="failed"),
        order(3, 1, "2001-03-01T09:00:00", status="failed"),
        order(4, 1, "2001-03-01T10:00:00", 7),
        order(5, 1, "2001-03-02T10:00:00", 9),
        order(6, 1, "2001-03-02T10:00:01", 9),
    ])
    found = rows_of(failed_payment_recovery(store, AS_OF))
    # the failure of January 31 reaches 10:00:00 on March 2, inclusive
    assert [(r["failed_count"], r["recovered_count"], float(r["recovered_revenue"])) for r in found] == [
        (1, 2, 16.0), (1, 3, 25.0), (1, 3, 25.0)]


def test_breakdown_equals_history_lookup(busy):
    store, orders = busy
    paid = [(w, o) for w, o in _months(orders) if o["status"] in ("complete", "edd_subscription")]
    expected = defaultdict(lambda: [Decimal(0)] * 5)
    for when, o in paid:
        total = Decimal(str(o["total"]))
        earlier = [Decimal(str(q["total"])) for w, q in paid if o["customer_id"] and q["customer_id"] == o["customer_id"] and w < when]
        sale, line = o["type"] == "sale", expected[when.strftime("%Y-%m-01")]
        line[0] += total if sale and not earlier else 0
        line[1] += total if sale and earlier else 0
        line[2] += total if o["type"] == "renewal" else 0
        line[3] += total if sale and earlier and total > sum(earlier) / len(earlier) else 0
        line[4] += total
    names = ["new_customer_revenue", "existing_customer_revenue", "renewal_revenue", "upgrade_revenue", "total_revenue"]
    found = {r["date"]: [r[n] for n in names] for r in rows_of(revenue_breakdown(store, AS_OF))}
    assert found == dict(expected)


def test_running_before_in_blocks(spark):
    rng = random.Random(3)
    data = [(rng.choice([1, 1, 2, 3, None]), rng.randrange(-50, 50), i, rng.choice([None, 4])) for i in range(400)]
    rows = spark.createDataFrame(data, "k long, at long, a long, b long")
    for widths in ((1,), (10, 1), (1000, 7), (40, 10, 2)):
        found = running_before(rows, "k", "at", {"a": "sum", "b": "max"}, widths=widths).collect()
        assert len(found) == len(data)
        for r in found:
            earlier = [d for d in data if r["k"] is not None and d[0] == r["k"] and d[1] < r["at"]]
            assert r["a_before"] == (sum(d[2] for d in earlier) if earlier else None)
            assert r["b_before"] == max((d[3] for d in earlier if d[3] is not None), default=None)


def test_busy_hour_is_split(spark):
    """One key, one hour, many moments and totals: no window has more than a tenth of a second of them."""
    rows = spark.range(0, 200_000, 1, 8).selectExpr("1L AS k", "id * 17923 % 3600000000 AS at", "id % 977 AS a")
    found = running_before(rows, "k", "at", {"a": "sum"})
    blocks = found.groupBy("block_0", "block_1").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    assert blocks[0] <= 40 and blocks[1] >= 30_000
    sums = found.orderBy("at").select("at", "a", "a_before").collect()
    running = 0
    for row in sums:
        assert (row.a_before or 0) == running
        running += row.a


def test_busy_hour_tasks_are_even(spark):
    """The rows of one customer's busy hour go to all tasks, in about equal parts."""
    rows = spark.range(0, 100_000, 1, 8).selectExpr("CASE WHEN id % 10 < 9 THEN 1L ELSE id END AS k", "id * 17923 % 3600000000 AS at", "id AS a")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        parts = running_before(rows, "k", "at", {"a": "sum"}).groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
        sizes = [row.n for row in parts.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert len(sizes) == 16 and max(sizes) < 2 * 100_000 / 16


@pytest.mark.parametrize("descending", [False, True])
def test_value_ranks(spark, descending):
    rng = random.Random(5)
    values = [Decimal(rng.choice([0, 0, 0, 12.34, -7, 655.35, 655.36, 9_999_999.99, rng.randrange(10**9)])).quantize(Decimal("0.01")) for _ in range(900)]
    df = spark.createDataFrame([(v,) for v in values], "v decimal(18,2)")
    ranks = value_ranks(value_counts(df, "v"), "v", descending).collect()
    for r in ranks:
        assert r["n"] == values.count(r["v"])
        assert r["n_before"] == sum(v > r["v"] if descending else v < r["v"] for v in values)
    assert {r["v"] for r in ranks} == set(values)


def test_pareto_running_totals(spark):
    rng = random.Random(11)
    data = [(i, Decimal(rng.choice([0, 5, 5, 70_000, rng.randrange(10**6)]))) for i in range(500)]
    found = dashboard.pareto(spark.createDataFrame(data, "id long, revenue decimal(18,2)")).collect()
    assert len(found) == len(data)
    running = Decimal(0)
    for r in sorted(found, key=lambda r: (-r["revenue"], r["cumulative_revenue"])):
        running += r["revenue"]
        assert r["cumulative_revenue"] == running
    assert max(r["cumulative_percentage"] for r in found) == 100.0


def test_pareto_text_keys_with_a_common_prefix(spark):
    """Equal amounts, keys that differ behind 30 characters only: ranges of keys stay even."""
    rows = spark.range(0, 20_000, 1, 4).selectExpr("concat(repeat('x', 30), lpad(string(id * 7919 % 20000), 9, '0')) AS id", "CAST(5 AS DECIMAL(18,2)) AS revenue")
    sizes = [row[1] for row in ranged(rows, ["id"]).groupBy("range").count().collect()]
    assert len(sizes) > 400 and max(sizes) < 20 * 20_000 / 512
    found = dashboard.pareto(rows).orderBy("id").collect()
    assert [row.cumulative_revenue for row in found] == [5 * (k + 1) for k in range(20_000)]


def test_a_million_labels_are_numbered_in_ranges(spark):
    rows = spark.range(0, 1_000_000, 1, 8).selectExpr("concat('cohort-', lpad(string(id), 12, '0')) AS cohort", "id")
    places = label_places(rows, "cohort", "at")
    wrong = rows.join(places, "cohort").filter("id <> at").count()
    assert wrong == 0 and places.count() == 1_000_000
    windows = re.findall(r"windowspecdefinition\((\w+)#", places._jdf.queryExecution().executedPlan().toString())
    assert set(windows) == {"range"}


def test_long_lists_are_cut_by_rank(spark, monkeypatch):
    monkeypatch.setattr(sales, "MERGED", 100)
    rows = spark.range(0, 5000, 1, 4).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 13 AS DECIMAL(18,2)) END AS v", "concat('k', id % 50) AS name")
    for order, plain in (
        (("-v", "id"), (F.col("v").desc(), "id")), (("v", "-id"), (F.col("v").asc(), F.desc("id"))),
        ((F.col("name"), "-v", "id"), ("name", F.desc("v"), "id")),
    ):
        for limit in (101, 2500, 4999, 6000):
            assert sales.head(rows, limit, *order).collect() == rows.orderBy(*plain).limit(limit).collect()
    long = sales.head(rows, 10**8, "-v", "id")._jdf.queryExecution().executedPlan().toString()
    # the only limited lists are the samples that the ranges are cut at
    assert set(re.findall(r"TakeOrderedAndProject\(limit=(\d+)", long)) == {"512"} and "GlobalLimit" not in long and "CollectLimit" not in long
    assert sales.head(rows, 50, "-v", "id")._jdf.queryExecution().executedPlan().toString().count("TakeOrderedAndProject(limit=50") == 1
