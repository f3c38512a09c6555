"""A value for several places of an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once a row. A Column written several times, or inside a
    lambda, is computed at each place, and in a lambda for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
