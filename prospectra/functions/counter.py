"""Random numbers by counter: a hash of (seed, id), the same for any partitioning and order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, key: Column) -> Column:
    """In (0, 1): 52 bits of an MD5 of seed and key, at the middle of their cell."""
    text = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(text, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def uniform_sql(seed: int | str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"
