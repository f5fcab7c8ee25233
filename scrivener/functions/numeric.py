"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(c, digits: int = 6) -> Column:
    """Round a double to ``digits`` decimals as ``round(x * 10^d) / 10^d``
    on the binary value, half away from zero: the same value SQL engines
    compute. (``F.round(x, d)`` rounds the decimal string half-up, so a
    value printed as 0.2605625 but stored just below would round the other
    way.)"""
    col = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** digits)
    return F.round(col.cast("double") * scale, 0) / scale
