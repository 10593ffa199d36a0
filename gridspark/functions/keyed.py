"""Keyed random numbers: the same key gives the same draw on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# An epoch shifts the seed by this stride.
EPOCH_STRIDE = 7919


def _part(v) -> Column:
    return v.cast("string") if isinstance(v, Column) else F.lit(str(v))


def uniform(seed, *key) -> Column:
    """Uniform in [0, 1) from the md5 of ``seed|key..``."""
    digest = F.md5(F.concat_ws("|", _part(seed), *[_part(k) for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(seed, *key) -> Column:
    """Standard normal by Box-Muller from two keyed uniforms."""
    u1 = F.greatest(uniform(seed, *key, "n1"), F.lit(1.0 / 4294967296.0))
    u2 = uniform(seed, *key, "n2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def epoch_seed(seed: int, epoch: int) -> int:
    return int(seed) + EPOCH_STRIDE * int(epoch)
