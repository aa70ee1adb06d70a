from __future__ import annotations

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import order, rows_of
from tillwise import Store
from tillwise.operators.products import top_products
from tillwise.operators.revenue import refund_rates_by_month, revenue_by_month, revenue_by_region
from tillwise.operators.subscriptions import top_licenses
from tillwise.sources.schemas import KEYS, SCHEMAS
from tillwise.sources.store import key_ranges


def test_missing_optional_table_gives_an_empty_report(spark, make_store):
    full = make_store(orders=[order(1, 1, "2001-01-01")])
    store = Store.from_frames(spark, {t: full.table(t) for t in ("customers", "orders", "subscriptions")})
    assert not store.has("licenses")
    report = top_licenses(store, "2001-08-02")
    assert report.columns == ["license_id", "license_key", "activation_count", "download_name"]
    assert report.collect() == []


def test_required_tables(spark, make_store):
    full = make_store()
    store = Store.from_frames(spark, {"customers": full.customers, "orders": full.orders})
    found = {r["table_name"]: r["present"] for r in store.required_tables().collect()}
    assert found == {"customers": True, "orders": True, "subscriptions": False}
    with pytest.raises(LookupError):
        store.subscriptions
    with pytest.raises(ValueError):
        Store.from_frames(spark, {"invoices": full.orders})


def test_parquet_round_trip(spark, make_store, tmp_path):
    make_store(orders=[order(1, 1, "2001-01-01", 12.5)]).write_parquet(f"{tmp_path}/shop", prefix="dev_")
    store = Store.from_parquet(spark, f"{tmp_path}/shop", prefix="dev_")
    assert rows_of(revenue_by_month(store, "2001-08-02"))[0]["label"] == "January 2001"
    assert not Store.from_parquet(spark, f"{tmp_path}/shop", prefix="other_").has("orders")


def test_catalog_names_and_other_spellings(spark, make_store):
    store = make_store(orders=[order(1, 1, "2001-01-01")])
    store.orders.createOrReplaceTempView("wp7_edd_orders")
    text = spark.createDataFrame([("a@b", "edd_payment_note", "hi")], "comment_author_email string, comment_type string, comment_content string")
    text.createOrReplaceTempView("wp7_comments")
    found = Store.from_catalog(spark, prefix="wp7_")
    assert found.has("orders") and not found.has("products")
    assert found.notes.collect()[0]["content"] == "hi"


def test_tables_are_cast_to_the_declared_schema(spark):
    raw = spark.sql(
        "SELECT 1 AS ID, '2' AS customer_id, 'complete' AS status, 'sale' AS type, 3.456D AS total,"
        " TIMESTAMP_NTZ'2001-01-31 23:59:59' AS date_created"
    )
    store = Store.from_frames(spark, {"orders": raw})
    assert store.orders.dtypes == [(f.name, f.dataType.simpleString()) for f in SCHEMAS["orders"]]
    row = store.orders.select("id", "customer_id", "total", F.date_format("date_created", "yyyy-MM-dd HH:mm:ss"), "ip").first()
    assert (row[0], row[1], str(row[2]), row[3], row[4]) == (1, 2, "3.46", "2001-01-31 23:59:59", None)


class _Reader:
    """Records what JDBC reads would be asked for; no database is started for tests."""

    def __init__(self, spark, frames, bounds):
        self.spark, self.frames, self.bounds, self.asked = spark, frames, bounds, []

    def format(self, name):
        assert name == "jdbc"
        self.asked.append({})
        return self

    def option(self, key, value):
        self.asked[-1][key] = value
        return self

    def options(self, **more):
        self.asked[-1].update(more)
        return self

    def load(self):
        table = self.asked[-1]["dbtable"]
        if table.startswith("(SELECT"):
            return self.spark.createDataFrame([self.bounds], "n long, low long, high long")
        return self.frames


def jdbc_store(spark, make_store, monkeypatch, bounds, **more):
    reader = _Reader(spark, make_store().orders, bounds)
    monkeypatch.setattr(type(spark), "read", property(lambda self: reader))
    return Store.from_jdbc(spark, "jdbc:mysql://db/shop", "wp_", {"user": "u"}, present={"orders"}, **more), reader


BASE = {"url": "jdbc:mysql://db/shop", "user": "u"}


def test_jdbc_reads_are_split_by_key_bounds(spark, make_store, monkeypatch):
    store, reader = jdbc_store(spark, make_store, monkeypatch, (3_500_000, 7, 9_000_000))
    assert store.has("orders") and store.has("orders") and not store.has("products")
    assert reader.asked == [
        BASE | {"dbtable": "(SELECT count(*) AS n, min(id) AS low, max(id) AS high FROM wp_edd_orders) bounds"},
        BASE | {"dbtable": "wp_edd_orders", "partitionColumn": "id", "lowerBound": 7, "upperBound": 9_000_001, "numPartitions": 4},
    ]


def test_jdbc_small_tables_take_one_connection(spark, make_store, monkeypatch):
    for bounds in ((0, None, None), (12, 1, 12)):
        store, reader = jdbc_store(spark, make_store, monkeypatch, bounds)
        assert store.has("orders") and reader.asked[-1] == BASE | {"dbtable": "wp_edd_orders"}


def test_jdbc_large_tables_are_refused_without_bounds(spark, make_store, monkeypatch):
    store, _ = jdbc_store(spark, make_store, monkeypatch, (11, 5, 5), rows_per_read=10)
    with pytest.raises(ValueError, match="orders has 11 rows and no range of id"):
        store.orders


def test_jdbc_split_of_the_caller(spark, make_store, monkeypatch):
    split = {"partitionColumn": "date_created", "lowerBound": "2000-01-01", "upperBound": "2001-01-01", "numPartitions": 4}
    store, reader = jdbc_store(spark, make_store, monkeypatch, (1, 1, 1), split={"orders": split})
    assert store.has("orders") and reader.asked == [BASE | {"dbtable": "wp_edd_orders"} | split]


def test_key_ranges():
    assert key_ranges("orders", 10**12, 1, 10**13)["numPartitions"] == 512
    assert key_ranges("order_items", 5_000_000, 1, 3) == {"partitionColumn": "order_id", "lowerBound": 1, "upperBound": 4, "numPartitions": 3}
    assert set(KEYS) == set(SCHEMAS)


def orders_by_month(make_store):
    months = [f"{2000 + k // 12}-{1 + k % 12:02d}-15T10:00:00" for k in range(24)]
    return make_store(orders=[order(k, k % 5, month, 10 + k) for k, month in enumerate(months)] + [order(99, 1, None, 5)])


def test_ranged_reports_read_their_months_only(spark, make_store, tmp_path):
    source = orders_by_month(make_store)
    source.write_parquet(f"{tmp_path}/shop")
    folders = {entry.name for entry in os.scandir(f"{tmp_path}/shop/orders") if entry.is_dir()}
    assert len(folders) == 25 and {"date_created_month=200001", "date_created_month=200112"} <= folders
    # whoever opens the last month fails
    with open(f"{tmp_path}/shop/orders/date_created_month=200112/part-unreadable.parquet", "wb") as file:
        file.write(b"not a parquet file")
    store = Store.from_parquet(spark, f"{tmp_path}/shop")
    assert store.orders.columns == source.orders.columns
    for start, end in (("2000-03-01", "2000-07-31"), (None, "2001-06-30"), ("2000-12-15", "2001-11-15")):
        for report in (revenue_by_month, refund_rates_by_month, revenue_by_region, top_products):
            assert report(store, "2001-08-02", start, end).collect() == report(source, "2001-08-02", start, end).collect()
    assert len(revenue_by_month(store, "2001-08-02", "2000-03-01", "2000-07-31").collect()) == 5
    with pytest.raises(Exception, match="200112"):
        revenue_by_month(store, "2001-08-02").collect()


def test_orders_without_date_are_kept(spark, make_store, tmp_path):
    source = orders_by_month(make_store)
    source.write_parquet(f"{tmp_path}/shop")
    store = Store.from_parquet(spark, f"{tmp_path}/shop")
    assert sorted(map(str, store.orders.collect())) == sorted(map(str, source.orders.collect()))
    assert revenue_by_month(store, "2001-08-02").collect() == revenue_by_month(source, "2001-08-02").collect()


def test_bucketed_tables_meet_without_a_shuffle(spark, shop, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS bucketed LOCATION '{tmp_path}/bucketed'")
    source = shop.store()
    source.write_catalog("wp_", "bucketed", buckets=4, tables=("orders", "order_items", "products", "customers", "subscriptions"))
    store = Store.from_catalog(spark, "wp_", "bucketed")
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for key in settings:
            spark.conf.set(key, "-1")
        report = top_products(store, "2001-08-02")
        found = report.collect()
        plan = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.sql("DROP DATABASE bucketed CASCADE")
    assert found == top_products(source, "2001-08-02").collect()
    assert "SortMergeJoin" in plan and "hashpartitioning(order_id" not in plan and "hashpartitioning(id#" not in plan


def test_reading_a_missing_column_is_an_error(spark, make_store):
    full = make_store(orders=[order(1, 1, "2001-01-01", 12.5)])
    for column in ("total", "type", "status", "date_created"):
        store = Store.from_frames(spark, {"customers": full.customers, "orders": full.orders.drop(column)})
        with pytest.raises(PySparkException, match=f"orders has no column {column}"):
            revenue_by_month(store, "2001-08-02").collect()
    without_gateway = Store.from_frames(spark, {"customers": full.customers, "orders": full.orders.drop("gateway")})
    assert rows_of(revenue_by_month(without_gateway, "2001-08-02"))[0]["label"] == "January 2001"
