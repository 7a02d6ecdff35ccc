"""Expressions on probability vectors and measurements."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bind

FLOOR = 1e-12


def _shares(x: Column) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return bind(x, lambda e: bind(total(e), lambda t: F.transform(e, lambda v: v / t)))


def softmax(x: Column) -> Column:
    return bind(x, lambda y: bind(F.array_max(y), lambda top: _shares(F.transform(y, lambda v: F.exp(v - top)))))


def clipped_log(p: Column) -> Column:
    return F.ln(F.least(F.greatest(p, F.lit(FLOOR)), F.lit(1.0)))


def temperature(p: Column, t: Column | float) -> Column:
    t = t if isinstance(t, Column) else F.lit(float(t))
    return softmax(F.transform(p, lambda v: clipped_log(v) / t))


def undo_temperature(p: Column, t: float) -> Column:
    return _shares(F.transform(p, lambda v: F.pow(v, F.lit(float(t)))))


def argmax(p: Column) -> Column:
    """The first index of the greatest value."""
    return bind(p, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def accepted(p: Column, threshold: float = 0.8) -> Column:
    return F.array_max(p) >= threshold


def smoothed_cross_entropy(p: Column, truth: Column, epsilon: float, classes: int) -> Column:
    """(1 - e) * -ln p_truth + e / k * sum of -ln p over all classes."""
    every = F.aggregate(F.transform(p, lambda v: -clipped_log(v)), F.lit(0.0), lambda a, b: a + b)
    return (1 - epsilon) * -clipped_log(F.get(p, truth)) + epsilon / classes * every


def smoothing_floor(epsilon: float, classes: int) -> float:
    """The least value that smoothed_cross_entropy can take: the entropy of the smoothed target."""
    hit, miss = 1 - epsilon + epsilon / classes, epsilon / classes
    return -(hit * math.log(hit) + (classes - 1) * (miss * math.log(miss) if miss else 0.0))


def round1(x: Column) -> Column:
    """One decimal by the exact binary value, ties to even (0.35 gives 0.3, 1.15 gives 1.1; Spark's round uses the
    shortest decimal and gives 0.4 and 1.2).

    The value is compared with the tie between tenths without rounding: 16 x and 4 x are exact, and so are both sums.
    """
    a = F.abs(x.cast("double"))
    low = F.floor(a * 10)
    side = (a * 16 - (2 * low + 1)) + a * 4
    tenths = F.when(side > 0, low + 1).when(side < 0, low).otherwise(low + low % 2)
    return F.when(x < 0, -(tenths / 10)).otherwise(tenths / 10)


def per_second(amount: Column, seconds: Column) -> Column:
    return F.try_divide(amount, seconds)


def human_bytes(n: Column) -> Column:
    """Binary units with two decimals."""
    text, step = None, n.cast("double")
    for i, unit in enumerate(("B", "KiB", "MiB", "GiB", "TiB")):
        shown = F.format_string(f"%.2f {unit}", step / F.lit(float(1024**i)))
        text = F.when(step < 1024 ** (i + 1), shown) if text is None else text.when(step < 1024 ** (i + 1), shown)
    return text.otherwise(F.format_string("%.2f PiB", step / F.lit(float(1024**5))))


def hms(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


#: A whole number without leading zeros, and a unit.
MEMORY_LIMIT = "[1-9][0-9]*[KMGT]"


def is_memory_limit(text: Column) -> Column:
    return F.coalesce(text.rlike(f"^{MEMORY_LIMIT}$") & ~text.contains("\n"), F.lit(False))


def memory_limit(text: str) -> str:
    """A size such as 48G; anything else is an error."""
    if not re.fullmatch(MEMORY_LIMIT, text):
        raise ValueError(f"not a memory limit: {text!r}")
    return text
