"""Rounding as SQL engines on binary doubles do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column | str, digits: int) -> Column:
    """``c`` to that many decimals: multiplied, rounded half away from zero, divided.

    ``F.round`` looks at the shortest decimal spelling instead, which is a tie for more values: 82/1280 is spelt 0.0640625 and lies below it.
    """
    power = float(10**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * power) / power
