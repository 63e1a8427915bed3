"""Random numbers that depend on a seed and a key only.

They do not change with the partitioning or on a retried task, and any
engine that has md5 can repeat them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .maths import as_col

SPAN = 4294967296.0


def key_hash(seed, *keys) -> Column:
    """The first 32 bits of md5('seed:key[:key...]') as a long."""
    parts = [F.lit(str(seed))] + [as_col(k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def uniform(seed, *keys) -> Column:
    """A double in [0, 1)."""
    return key_hash(seed, *keys).cast("double") / F.lit(SPAN)


def normal(seed, *keys) -> Column:
    """Standard normal by Box-Muller on two hashed numbers."""
    u = (key_hash(f"{seed}/u", *keys).cast("double") + 1.0) / F.lit(SPAN)
    v = uniform(f"{seed}/v", *keys)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)
