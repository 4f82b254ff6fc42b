"""What counts as a missing value. Each rule is named, and every operator says which one it uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text tokens read as missing.
NA_TOKENS = ["", "na", "n/a", "nan", "missing", ".", "-"]
# Placeholders accepted in replicate columns.
PLACEHOLDERS = ["", "na", "n/a", "null", "none", "-", ".", "?", "n.d."]


def is_missing(v: Column, rule: str = "positive") -> Column:
    """True where ``v`` is missing.

    ``null``      null or NaN
    ``zero``      null, NaN or exactly 0
    ``positive``  anything but a finite value above 0
    """
    absent = v.isNull() | F.isnan(v)
    if rule == "null":
        return absent
    if rule == "zero":
        return absent | (v == 0)
    if rule == "positive":
        return absent | (v <= 0)
    raise ValueError(f"unknown rule {rule!r}")


def na_to_null(c: Column) -> Column:
    """Null for the missing tokens, else the trimmed text."""
    text = F.trim(c)
    return F.when(~F.lower(text).isin(NA_TOKENS), text)


def is_placeholder(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(PLACEHOLDERS)


def transformed(v: Column, kind: str) -> Column:
    """Value on a working scale: ``none``, ``log10p1``, ``log2p1``, ``log2`` or ``log10``."""
    scale = {
        "none": lambda x: x,
        "log10p1": lambda x: F.log10(1 + x),
        "log2p1": lambda x: F.log2(1 + x),
        "log2": F.log2,
        "log10": F.log10,
    }
    return scale[kind](v)
