"""Pixel arithmetic of tissue filters, on arrays of packed RGB integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The inclusive tissue range of hue, saturation and value.
RANGE = ((90, 180), (8, 255), (103, 255))
SHIFT = 12


def hsv(rgb: Column) -> Column:
    """h (0 to 179), s and v of a packed 0xRRGGBB pixel in 12-bit fixed point."""
    r, g, b = (F.shiftright(rgb, n).bitwiseAND(F.lit(255)) for n in (16, 8, 0))
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = v - low
    half = 1 << (SHIFT - 1)
    over = lambda top, n: F.when(n == 0, 0).otherwise(F.bround(F.lit(float(top << SHIFT)) / n).cast("int"))
    s = F.shiftright(d * over(255, v) + half, SHIFT)
    base = F.when(v == r, g - b).when(v == g, b - r + 2 * d).otherwise(r - g + 4 * d)
    h = F.shiftright(base * F.when(d == 0, 0).otherwise(F.bround(F.lit(float(180 << SHIFT)) / (6.0 * d)).cast("int")) + half, SHIFT)
    return F.struct(F.when(h < 0, h + 180).otherwise(h).cast("int").alias("h"), s.cast("int").alias("s"), v.cast("int").alias("v"))


def in_range(pixel: Column, bounds=RANGE) -> Column:
    x = hsv(pixel)
    return x["h"].between(*bounds[0]) & x["s"].between(*bounds[1]) & x["v"].between(*bounds[2])


def coverage(pixels: Column, bounds=RANGE) -> Column:
    """Fraction of an array of pixels inside the range; an empty one covers nothing."""
    return F.when(F.size(pixels) == 0, 0.0).otherwise(F.size(F.filter(pixels, lambda p: in_range(p, bounds))) / F.size(pixels))


def enough_tissue(pixels: Column, minimum: float = 0.45) -> Column:
    return coverage(pixels) >= minimum


def enough_percent(pixels: Column, percent: float = 60.0) -> Column:
    return coverage(pixels) * 100 >= percent


def integral(cells: DataFrame, image: str, row: str, column: str, value: str) -> DataFrame:
    """Two-dimensional prefix sums, one image per window partition."""
    across = Window.partitionBy(image, row).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(image, column).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("_a", F.sum(value).over(across)).withColumn("integral", F.sum("_a").over(down)).drop("_a")


def box_sum(whole: Column, above: Column, left: Column, corner: Column) -> Column:
    """Sum over a rectangle from four prefix sums; those outside the image are null."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return whole - zero(above) - zero(left) + zero(corner)
