"""Texts of numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS = "−"


def plain(x: Column, digits: int = 1) -> Column:
    """Fixed digits with a true minus sign."""
    return F.concat(F.when(x < 0, F.lit(MINUS)).otherwise(F.lit("")), F.when(x.isNotNull(), F.format_string(f"%.{digits}f", F.bround(F.abs(x), digits))))


def signed(x: Column, digits: int = 1) -> Column:
    """As :func:`plain`, with a plus sign from zero on."""
    return F.concat(F.when(x < 0, F.lit(MINUS)).otherwise(F.lit("+")), F.when(x.isNotNull(), F.format_string(f"%.{digits}f", F.bround(F.abs(x), digits))))


def fixed(x: Column, digits: int) -> Column:
    """A number with fixed digits, halves to even."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def fill(template: str, **values: Column) -> Column:
    """``template`` with each {name} replaced by the column of that name; null if one of them is."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])
