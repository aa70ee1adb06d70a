"""Declared schema of every store table.

``PHYSICAL`` is the name a table has in the shop database, after the prefix.
"""

from __future__ import annotations

from pyspark.sql import types as T

_MONEY = T.DecimalType(18, 2)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_ID, _TEXT, _INT, _TIME = T.LongType(), T.StringType(), T.IntegerType(), T.TimestampType()

SCHEMAS: dict[str, T.StructType] = {
    "customers": _table(
        id=_ID, email=_TEXT, name=_TEXT, date_created=_TIME, purchase_count=_ID, purchase_value=_MONEY
    ),
    "orders": _table(
        id=_ID, parent=_ID, customer_id=_ID, status=_TEXT, type=_TEXT, gateway=_TEXT,
        email=_TEXT, ip=_TEXT, total=_MONEY, date_created=_TIME,
    ),
    "order_items": _table(order_id=_ID, product_id=_ID, quantity=_INT, total=_MONEY),
    "order_addresses": _table(order_id=_ID, type=_TEXT, country=_TEXT),
    "subscriptions": _table(
        id=_ID, customer_id=_ID, parent_payment_id=_ID, status=_TEXT,
        initial_amount=_MONEY, recurring_amount=_MONEY, created=_TIME, expiration=_TIME,
    ),
    "licenses": _table(id=_ID, license_key=_TEXT, download_id=_ID, status=_TEXT),
    "license_activations": _table(license_id=_ID, site_name=_TEXT),
    "customermeta": _table(customer_id=_ID, meta_key=_TEXT, meta_value=_TEXT),
    "customer_email_addresses": _table(customer_id=_ID),
    "products": _table(id=_ID, post_title=_TEXT, post_parent=_ID),
    "product_meta": _table(post_id=_ID, meta_key=_TEXT, meta_value=_TEXT),
    "notes": _table(comment_author_email=_TEXT, comment_type=_TEXT, content=_TEXT),
}

REQUIRED = ("customers", "orders", "subscriptions")

# Table names in the shop database, after the site prefix.
PHYSICAL = {
    "customers": "edd_customers",
    "orders": "edd_orders",
    "order_items": "edd_order_items",
    "order_addresses": "edd_order_addresses",
    "subscriptions": "edd_subscriptions",
    "licenses": "edd_licenses",
    "license_activations": "edd_license_activations",
    "customermeta": "edd_customermeta",
    "customer_email_addresses": "edd_customer_email_addresses",
    "products": "posts",
    "product_meta": "postmeta",
    "notes": "comments",
}

# Other spellings a source may use for a declared column.
ALIASES = {("notes", "content"): ("comment_content",)}

# Integer column of each table that a database can be read by in ranges.
KEYS = {
    "customers": "id",
    "orders": "id",
    "order_items": "order_id",
    "order_addresses": "order_id",
    "subscriptions": "id",
    "licenses": "id",
    "license_activations": "license_id",
    "customermeta": "customer_id",
    "customer_email_addresses": "customer_id",
    "products": "ID",
    "product_meta": "post_id",
    "notes": "comment_ID",
}
