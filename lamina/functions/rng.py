"""Counter-based random numbers: unsigned 64-bit values that depend on (seed, draw, stream) alone.

Spark has no unsigned modular arithmetic, so values come from one vectorised
function on NumPy's uint64; columns carry them as signed longs of equal bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Odd constants of draw and stream, and those of the splitmix64 finaliser.
DRAW = 0xD2B74407B1CE6E93
STREAM = 0xCA5A826395121157
GOLDEN = 0x9E3779B97F4A7C15
FIRST = 0xBF58476D1CE4E5B9
SECOND = 0x94D049BB133111EB
MASK = (1 << 64) - 1


def values(seed: int, draw: np.ndarray, stream: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = np.uint64(seed & MASK) ^ (np.asarray(draw).astype(np.uint64) * np.uint64(DRAW)) ^ np.uint64((stream * STREAM) & MASK)
        z = z + np.uint64(GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
        return z ^ (z >> np.uint64(31))


def indices(r: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(r * size) >> 64 by halves, for sizes below 2**32."""
    r, n = r.astype(np.uint64), np.asarray(size).astype(np.uint64)
    low = (r & np.uint64(0xFFFFFFFF)) * n
    return (((r >> np.uint64(32)) * n + (low >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


def unit(r: np.ndarray) -> np.ndarray:
    """r over 2**64."""
    return r.astype(np.float64) / 2.0**64


def random_index(seed: int, draw: Column, stream: int, size: Column) -> Column:
    """A uniform index below size."""

    @F.pandas_udf("long")
    def index(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for d, n in batches:
            yield pd.Series(indices(values(seed, d.to_numpy(), stream), n.to_numpy()))

    return index(draw.cast("long"), size.cast("long"))


def random_unit(seed: int, draw: Column, stream: int) -> Column:
    @F.pandas_udf("double")
    def number(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for d in batches:
            yield pd.Series(unit(values(seed, d.to_numpy(), stream)))

    return number(draw.cast("long"))


def shares(weights: dict, tolerance: float = 1e-8) -> list[tuple]:
    """(key, upper bound) in key order: zero weights are left out, the rest must sum to 1, the last bound is 1."""
    kept = sorted((k, float(w)) for k, w in weights.items() if w)
    if any(w < 0 for _, w in kept) or abs(sum(w for _, w in kept) - 1) > tolerance:
        raise ValueError("weights are not negative and sum to 1")
    bounds = np.cumsum([w for _, w in kept])
    bounds[-1] = 1.0
    return [(k, float(b)) for (k, _), b in zip(kept, bounds, strict=True)]


def choice(number: Column, weights: dict) -> Column:
    """The first key whose bound is above the number."""
    out = None
    for key, bound in shares(weights):
        out = F.when(number < bound, F.lit(key)) if out is None else out.when(number < bound, F.lit(key))
    return out
