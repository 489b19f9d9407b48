"""Seeded hashes that do not depend on partitioning or engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def hash60(*cols: str | Column, seed: int = 42) -> Column:
    """Uniform integer in [0, 2**60) from the key columns and the seed."""
    text = F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def uniform(*cols: str | Column, seed: int = 42) -> Column:
    """Uniform double strictly between 0 and 1."""
    return (F.shiftright(hash60(*cols, seed=seed), 8) + F.lit(0.5)) / F.lit(float(1 << 52))
