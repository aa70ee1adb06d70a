"""Store and subscription analytics as lazy Spark DataFrame operators."""

from tillwise.session import build_session, configure
from tillwise.sources.store import Store

__all__ = ["Store", "build_session", "configure"]
