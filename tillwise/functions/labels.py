"""Classification rules as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwise.functions import fixed_values as fv


def first_match(rules: Iterable[tuple[Column, object]], otherwise: object) -> Column:
    """Value of the first rule that holds. A NULL condition does not hold."""
    chain = None
    for condition, value in rules:
        chain = (chain if chain is not None else F).when(condition, value)
    return chain.otherwise(otherwise)


def position(label: Column, ordered: Iterable[str]) -> Column:
    """Sort key that puts labels in the given order."""
    return first_match(((label == name, i) for i, name in enumerate(ordered)), None)


def is_paid(status: Column | None = None) -> Column:
    return (F.col("status") if status is None else status).isin(*fv.PAID_STATUSES)


def region_of(country: Column) -> Column:
    return first_match(
        ((country.isin(*codes), name) for name, codes in fv.REGIONS), fv.REGION_OTHER
    )


def channel_of(text: Column) -> Column:
    """Acquisition channel named in a note; letter case does not matter."""
    lowered = F.lower(text)
    return first_match(
        ((lowered.contains(mark), name) for mark, name in fv.CHANNELS), fv.CHANNEL_OTHER
    )


def recency_score(days: Column) -> Column:
    return first_match(((days <= top, score) for top, score in ((30, 5), (60, 4), (90, 3), (180, 2))), 1)


def frequency_score(orders: Column) -> Column:
    return first_match(((orders >= low, score) for low, score in ((10, 5), (7, 4), (4, 3), (2, 2))), 1)


def monetary_score(amount: Column) -> Column:
    return first_match(
        ((amount >= low, score) for low, score in ((5000, 5), (2000, 4), (1000, 3), (500, 2))), 1
    )


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    champions, loyal, big, recent, risk, lost, rest = fv.RFM_SEGMENTS
    return first_match(
        (
            (r + f + m >= 13, champions),
            ((r + f + m >= 10) & (r >= 4), loyal),
            ((m >= 4) & (r + f >= 6), big),
            ((r >= 4) & (f <= 2), recent),
            ((f >= 4) & (r <= 2), risk),
            ((r <= 2) & (f <= 2), lost),
        ),
        rest,
    )


def first_purchase_class(days: Column) -> Column:
    """Signup after the first purchase gives negative days; those count as "1 Day"."""
    rules = [(days == 0, fv.FIRST_PURCHASE_SAME_DAY)]
    rules += [(days <= top, name) for top, name in fv.FIRST_PURCHASE_CLASSES]
    return first_match(rules, fv.FIRST_PURCHASE_REST)


FIRST_PURCHASE_ORDER = (
    fv.FIRST_PURCHASE_SAME_DAY,
    *(name for _, name in fv.FIRST_PURCHASE_CLASSES),
    fv.FIRST_PURCHASE_REST,
)


def trend_class(growth: Column) -> Column:
    return first_match(((growth > 5, "up"), (growth < -5, "down")), "flat")


def graded(value: Column, cuts: Iterable[tuple[float, str]], otherwise: str, rising: bool = True) -> Column:
    """Grade by thresholds: at least (rising) or at most (falling) each cut."""
    return first_match(
        ((value >= cut if rising else value <= cut, name) for cut, name in cuts), otherwise
    )
