"""Helpers for higher-order expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def string_array(values) -> Column:
    """A constant ``array<string>``, typed even when empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")
