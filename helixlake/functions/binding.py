"""Values that several parts of an expression use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once a row. A column that a lambda refers to is evaluated anew for every element, a lambda's
    own variable is not."""
    return F.get(F.transform(F.array(x), f), F.lit(0))
