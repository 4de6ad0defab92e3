"""Name an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` mentions it.

    Inside ``when`` branches Spark computes a repeated sub-expression again each time; the variable
    of a one-element transform is computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
