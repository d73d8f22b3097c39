"""Rating expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

TOLERANCE = 1e-9


def nan_as_null(value: Column) -> Column:
    """A rating that is no number is a missing rating."""
    return F.when(~F.isnan(value), value)


def round_half_even(value: Column) -> Column:
    return F.bround(value)


def near_integer(value: Column) -> Column:
    """False for NaN and infinities: Spark orders NaN above every number."""
    return F.abs(value - F.bround(value)) < TOLERANCE


def valid_label(value: Column, domain: Sequence[float]) -> Column:
    return near_integer(value) & F.bround(value).isin(*domain)


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``; null when there is nothing to divide by."""
    return F.try_divide(part * F.lit(100.0), whole)
