from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillwise.session import build_session  # noqa: E402
from tillwise.sources.sample_views import SampleShop  # noqa: E402
from tillwise.sources.schemas import SCHEMAS  # noqa: E402
from tillwise.sources.store import Store  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tillwise-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.driver.host": "localhost",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shop(spark):
    return SampleShop(spark, f"{TESTDATA}/sf0.001")


def ts(text: str) -> dt.datetime:
    """A timestamp value; PySpark takes aware values regardless of the machine's zone."""
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


def money(value) -> Decimal:
    return Decimal(str(value)).quantize(Decimal("0.01"))


@pytest.fixture(scope="session")
def make_store(spark):
    """Store from rows given as dicts; columns left out are NULL, tables left out are empty."""

    def build(**tables) -> Store:
        frames = {}
        for name, schema in SCHEMAS.items():
            rows = []
            for row in tables.get(name, []):
                unknown = set(row) - set(schema.fieldNames())
                assert not unknown, unknown
                values = []
                for field in schema:
                    value = row.get(field.name)
                    if value is not None and field.dataType.typeName() == "decimal":
                        value = money(value)
                    if value is not None and field.dataType.typeName() == "timestamp" and isinstance(value, str):
                        value = ts(value)
                    values.append(value)
                rows.append(tuple(values))
            frames[name] = spark.createDataFrame(rows, schema)
        return Store.from_frames(spark, frames)

    return build


def order(id, customer_id, created, total=10, status="complete", type="sale", **more):
    return {"id": id, "customer_id": customer_id, "date_created": created, "total": total, "status": status,
            "type": type, "parent": 0, **more}


def item(order_id, product_id, quantity=1, total=10):
    return {"order_id": order_id, "product_id": product_id, "quantity": quantity, "total": total}


def rows_of(df):
    return [row.asDict() for row in df.collect()]
