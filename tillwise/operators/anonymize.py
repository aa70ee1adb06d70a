"""Anonymisation of a store before it is shared.

E-mails, names and addresses are replaced; ids, amounts, dates, statuses and
counts stay as they are, so every report still works. The same e-mail gives the
same hash in customers and orders, so those still match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import fixed_values as fv
from tillwise.sources.store import Store


def anonymous_email(email: Column) -> Column:
    return F.concat(F.lit(fv.ANON_EMAIL_PREFIX), F.md5(email), F.lit(fv.ANON_EMAIL_DOMAIN))


def private_address(address: Column, row_key: Column, seed: str) -> Column:
    """An address in the private range, two octets in 1..254; NULL stays NULL.

    Octets come from a hash of the row key and a seed rather than from a random
    generator: a task that is run again gives the same table.
    """

    def octet(number: int) -> Column:
        digest = F.md5(F.concat(F.lit(f"{seed}:{number}:"), F.coalesce(row_key.cast("string"), F.lit(""))))
        return (F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % 254 + 1).cast("string")

    masked = F.concat(F.lit(fv.ANON_NETWORK), octet(1), F.lit("."), octet(2))
    return F.when(address.isNotNull(), masked)


def anonymize_customers(store: Store) -> DataFrame:
    name = F.concat(F.lit(fv.ANON_NAME_PREFIX), F.col("id").cast("string"))
    return store.customers.withColumns(
        {"email": anonymous_email(F.col("email")), "name": F.when(F.col("name").isNotNull(), name)}
    )


def anonymize_orders(store: Store, seed: str) -> DataFrame:
    return store.orders.withColumns(
        {
            "email": anonymous_email(F.col("email")),
            "ip": private_address(F.col("ip"), F.col("id"), seed),
        }
    )


def anonymize_customermeta(store: Store, seed: str) -> DataFrame:
    # A customer can have several addresses: the old value is part of the key, under the seed.
    owner = F.concat(F.coalesce(F.col("customer_id").cast("string"), F.lit("")), F.lit(":"), F.col("meta_value"))
    masked = private_address(F.col("meta_value"), owner, seed)
    is_address = F.col("meta_key") == fv.META_CUSTOMER_IP
    return store.customermeta.withColumn(
        "meta_value", F.when(is_address, masked).otherwise(F.col("meta_value"))
    )


def anonymize_notes(store: Store) -> DataFrame:
    """Note authors, hashed like the customer e-mails they are matched with."""
    return store.notes.withColumn(
        "comment_author_email", anonymous_email(F.col("comment_author_email"))
    )


def anonymize(store: Store, seed: str = "0", include_notes: bool = False) -> Store:
    """A store with anonymised customers, orders and customer attributes.

    Notes keep their author e-mail by default, as the original job leaves them
    alone; the acquisition channel report then finds no notes.
    ``include_notes=True`` hashes them too, which keeps that report working
    where both sides spell the address alike.
    """
    replaced = {
        "customers": anonymize_customers(store),
        "orders": anonymize_orders(store, seed),
        "customermeta": anonymize_customermeta(store, seed),
    }
    if include_notes:
        replaced["notes"] = anonymize_notes(store)
    return store.with_tables(**replaced)
