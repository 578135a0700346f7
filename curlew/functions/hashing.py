"""Repeatable pseudo-randomness: a uniform number per row from stable keys and a seed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*keys, seed) -> Column:
    """First 32 bits of the MD5 of the colon-joined keys and seed, as BIGINT."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(*keys, seed) -> Column:
    """Uniform number in the open interval (0, 1)."""
    return (hash32(*keys, seed=seed) + F.lit(0.5)) / F.lit(4294967296.0)
