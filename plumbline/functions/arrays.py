"""Array helpers for expressions that work inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use in ``body``.

    An expression named inside a lambda is evaluated again for every element; a
    lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(array: Column, index: Column) -> Column:
    """Zero-based element, NULL outside the array."""
    return F.get(array, index)
