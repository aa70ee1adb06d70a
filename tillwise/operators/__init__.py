"""The named reports.

Every report is ``name(store, as_of, ...) -> DataFrame``: lazy, typed, and a
function of the store and the given day only. ``OPERATORS`` lists them by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tillwise.operators import customers, financial, predictive, products, revenue, subscriptions

_MODULES = (revenue, subscriptions, customers, products, financial, predictive)

OPERATORS: dict[str, Callable[..., DataFrame]] = {
    name: getattr(module, name) for module in _MODULES for name in module.__all__
}
