"""Reproducible pseudo-random order from a keyed fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def order_key(seed: int | str, *parts: Column) -> Column:
    """Hex fingerprint of the parts and the seed; sorting by it is a fixed shuffle."""
    return F.md5(F.concat(*[p.cast("string") for p in parts], F.lit(str(seed))))


def key_bucket(key: Column, digits: int = 3) -> Column:
    """Leading hex digits as a number: buckets of equal expected size, in key order."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")
