"""Counter-based random numbers: a hash of seed and keys, the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_int(seed: int, *keys) -> Column:
    """A 32-bit number from the first eight hex digits of md5 of ``seed|key|key``."""
    said = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long")


def uniform(seed: int, *keys) -> Column:
    return hash_int(seed, *keys) / F.lit(4294967296.0)


def pick(values: list, seed: int, *keys) -> Column:
    """One of ``values``, evenly."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (hash_int(seed, *keys) % len(values) + 1).cast("int"))
