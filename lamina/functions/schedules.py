"""Learning schedules as expressions of the iteration number."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(i: Column, base: float, final: float, total: int, warmup: int = 0, start: float = 0.0, freeze: int = 0) -> Column:
    """0 while frozen, a line from start to base in the warm-up, then half a cosine to final; final from `total` on."""
    ramp = F.lit(start) + (F.lit(base) - start) * (i - freeze) / max(1, warmup - 1)
    steps = total - warmup - freeze
    wave = F.lit(final) + 0.5 * (base - final) * (1 + F.cos(math.pi * (i - warmup - freeze) / max(1, steps)))
    return F.when(i >= total, F.lit(final)).when(i < freeze, F.lit(0.0)).when(i < freeze + warmup, ramp).otherwise(wave)


def linear(i: Column, base: float, final: float, total: int, warmup: int = 0, start: float = 0.0) -> Column:
    ramp = F.lit(start) + (F.lit(base) - start) * i / max(1, warmup - 1)
    line = F.lit(base) + (F.lit(final) - base) * (i - warmup) / max(1, total - warmup - 1)
    return F.when(i >= total, F.lit(final)).when(i < warmup, ramp).otherwise(line)


def peak(i: Column, base: float, total: int, top: int, low: float = 0.0) -> Column:
    """Up to base at `top`, then down by half a cosine to low."""
    return F.when(i < top, F.lit(base) * i / max(1, top)).otherwise(F.lit(low) + 0.5 * (base - low) * (1 + F.cos(math.pi * (i - top) / max(1, total - top))))
