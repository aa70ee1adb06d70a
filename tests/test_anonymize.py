from __future__ import annotations

import re

from pyspark.sql import functions as F

from tests.conftest import order, rows_of
from tillwise.operators import OPERATORS
from tillwise.operators.anonymize import anonymize
from tillwise.sources.sample_views import AS_OF
from tillwise.sources.schemas import SCHEMAS

ADDRESS = re.compile(r"192\.168\.(\d+)\.(\d+)")
CHANGED = {"customers": ("email", "name"), "orders": ("email", "ip"), "customermeta": ("meta_value",)}


def test_only_personal_columns_change(shop):
    store = shop.store()
    safe = anonymize(store)
    for name in SCHEMAS:
        before, after = store.table(name), safe.table(name)
        kept = [c for c in before.columns if c not in CHANGED.get(name, ())]
        assert before.select(kept).exceptAll(after.select(kept)).isEmpty()
        assert before.count() == after.count()
        assert before.dtypes == after.dtypes


def test_values(make_store):
    store = anonymize(make_store(
        customers=[{"id": 7, "email": "a@b", "name": "Ann"}, {"id": 8}],
        orders=[order(1, 7, "2001-01-01", email="a@b", ip="8.8.8.8"), order(2, 8, "2001-01-01")],
        customermeta=[{"customer_id": 7, "meta_key": "_edd_customer_ip", "meta_value": "9.9.9.9"},
                      {"customer_id": 7, "meta_key": "_edd_customer_ip"}, {"customer_id": 7, "meta_key": "locale", "meta_value": "de"}],
    ))
    people = {r["id"]: (r["email"], r["name"]) for r in rows_of(store.customers)}
    assert people[7][1] == "Customer_7"
    assert re.fullmatch(r"anon_[0-9a-f]{32}@localhost\.dev", people[7][0]) and people[8] == (None, None)
    first, second = rows_of(store.orders.orderBy("id"))
    assert first["email"] == people[7][0]  # the same address still joins
    assert ADDRESS.fullmatch(first["ip"]) and second["ip"] is None and second["email"] is None
    values = {(r["meta_key"], r["meta_value"]) for r in rows_of(store.customermeta)}
    masked = {v for k, v in values if k == "_edd_customer_ip"}
    assert ("locale", "de") in values and None in masked and len(masked) == 2
    assert ADDRESS.fullmatch(next(v for v in masked if v))


def test_octets_stay_in_range_and_follow_the_seed(shop):
    store = shop.store()
    one, again, other = (anonymize(store, seed).orders.select("id", "ip") for seed in ("a", "a", "b"))
    assert one.exceptAll(again).isEmpty() and not one.exceptAll(other).isEmpty()
    octets = one.select(F.split("ip", r"\.").alias("o")).select(F.col("o")[2].cast("int").alias("x"), F.col("o")[3].cast("int").alias("y"))
    low, high, kinds = octets.agg(F.least(F.min("x"), F.min("y")), F.greatest(F.max("x"), F.max("y")), F.countDistinct("x")).first()
    assert low >= 1 and high <= 254 and kinds > 200


def test_reports_survive_except_for_the_notes(shop):
    store = shop.store()
    safe = anonymize(store)
    for name in ("revenue_by_month", "clv_distribution", "mrr_by_month"):
        assert OPERATORS[name](store, AS_OF).collect() == OPERATORS[name](safe, AS_OF).collect()
    channels = rows_of(OPERATORS["customer_acquisition_channels"](safe, AS_OF))
    assert [r["channel"] for r in channels] == ["Direct/Unknown"]


def test_notes_can_be_hashed_too(make_store):
    store = make_store(
        customers=[{"id": 1, "email": "a@b", "date_created": "2001-01-01"}],
        notes=[{"comment_author_email": "a@b", "comment_type": "edd_payment_note", "content": "utm_source=email"}],
    )
    found = rows_of(OPERATORS["customer_acquisition_channels"](anonymize(store, include_notes=True), AS_OF))
    assert [r["channel"] for r in found] == ["Email"]
