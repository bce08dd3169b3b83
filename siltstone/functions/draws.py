"""Reproducible draws: the order and the integers depend on the seed and the row's keys only, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def integer(seed: int, *keys: Column) -> Column:
    """A non-negative integer of 60 bits."""
    return F.conv(F.substring(order_key(seed, *keys), 1, 15), 16, 10).cast("bigint")
