"""JSON documents, masks and fingerprints of columns."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bucket names and their bits.
BUCKET_BITS = {"random": 0, "bridge": 1, "architecture_bridge": 2, "rare_clean": 3, "tissue_specific": 4, "architecture_specific": 5}


def distribution(name: Column, count: Column) -> Column:
    """Aggregate: positive counts by descending count, then name."""
    pair = F.when(count > 0, F.struct((-count).alias("minus"), name.alias("name")))
    return F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.struct(x["name"].alias("name"), (-x["minus"]).alias("n")))


def memberships(flags: dict[str, Column]) -> Column:
    """Names of the true flags, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(flag, F.lit(False)), F.lit(name)) for name, flag in flags.items()]))


def mask(flags: dict[str, Column], bits: dict[str, int] | None = None) -> Column:
    bits = bits or BUCKET_BITS
    return sum((F.when(flag, F.lit(1 << bits[name])).otherwise(F.lit(0)) for name, flag in flags.items()), F.lit(0)).cast("int")


def has_bit(masks: Column, name: str) -> Column:
    return F.getbit(masks, F.lit(BUCKET_BITS[name])) == 1


def row_fingerprint(columns: list[Column]) -> Column:
    """SHA-256 of the columns' texts, nulls marked."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns]), 256)


def canonical_hash(value, ascii_only: bool = True) -> str:
    """SHA-256 of the value's JSON with sorted keys and no blanks; non-finite numbers are refused."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only, allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


def attribute(value):
    """A plain Python value of a stored attribute: bytes as text, one-element lists as their element, non-finite numbers as text."""
    if isinstance(value, bytes):
        return value.decode("utf-8")
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return attribute(value[0]) if len(value) == 1 else [attribute(v) for v in value]
    return repr(value) if isinstance(value, float) and not math.isfinite(value) else value


def whole_number(column: Column, default: int) -> Column:
    return F.coalesce(F.expr("null") if column is None else column.try_cast("double").cast("int"), F.lit(default))
