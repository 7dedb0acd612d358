"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(text: Column | str, part: Column, count: Column | None = None) -> Column:
    """What stands before the first ``part``, or before the one of that number."""
    return F.call_function("substring_index", F.col(text) if isinstance(text, str) else text, part, F.lit(1) if count is None else count)
