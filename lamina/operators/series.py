"""Ordered analytics: runs, trailing meters, retention, change detection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.text import range_of


#: Rows of a group that one window orders; a longer group is dealt to several.
CHUNK = 100_000


def placed(rows: DataFrame, group: str, order: list[str], chunk: int = CHUNK) -> DataFrame:
    """Adds i, the position of each row in its group. Rows are dealt to ranges of the first order column; a range starts where the ranges before it end, so no window holds a whole group, however long."""
    dealt = rows.withColumn("_range", range_of(rows, order[0], chunk))
    counts = dealt.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)) - 1
    out = dealt.withColumn("_in", inside).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return out.withColumn("i", F.col("_in") + F.col("_start")).drop("_range", "_n", "_g", "_r", "_in", "_start")


def running(rows: DataFrame, group: str, value: Column, into: str, chunk: int = CHUNK) -> DataFrame:
    """Adds the sum of value over the rows of the group up to this one, by i, in two levels: totals of chunks of positions, and sums inside them."""
    dealt = rows.withColumn("_c", F.floor(F.col("i") / chunk)).withColumn("_v", value)
    earlier = Window.partitionBy(group).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(group, "_c").agg(F.sum("_v").alias("_t"))
    totals = totals.select(F.col(group).alias("_g"), F.col("_c").alias("_d"), F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy(group, "_c").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    out = dealt.withColumn("_in", inside).join(totals, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_c") == F.col("_d")))
    return out.withColumn(into, F.col("_in") + F.col("_before")).drop("_c", "_v", "_g", "_d", "_before", "_in")


def islands(rows: DataFrame, group: str, order: list[str], bad: Column, chunk: int = CHUNK) -> DataFrame:
    """Runs of consecutive bad rows in each group: group, run, first ordinal, length."""
    marked = placed(rows.select(group, *order, bad.alias("bad")), group, order, chunk)
    marked = running(marked, group, F.col("bad").cast("int"), "seen", chunk).withColumn("run", F.col("i") - F.col("seen") + 0)
    return marked.where("bad").groupBy(group, "run").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("length")).select(group, "first", "length")


def run_summary(runs: DataFrame, group: str) -> DataFrame:
    """Bad rows, runs, the longest run (the first of equals) of each group."""
    longest = F.min_by("first", F.struct(-F.col("length"), F.col("first")))
    return runs.groupBy(group).agg(F.sum("length").alias("n_bad"), F.count(F.lit(1)).alias("n_runs"), F.max("length").alias("longest"), longest.alias("longest_first"))


def trailing(rows: DataFrame, group: str, order: list[str], value: str, size: int = 20, chunk: int = CHUNK) -> DataFrame:
    """Lower median, mean and maximum of the last `size` values, and the mean of all so far.

    Positions are dealt to chunks; the last size - 1 rows of a chunk also stand at the head of the next one.
    """
    chunk = max(chunk, size)
    out = running(running(placed(rows, group, order, chunk), group, F.col(value).cast("double"), "_sum", chunk), group, F.col(value).isNotNull().cast("long"), "_n", chunk)
    at = F.floor(F.col("i") / chunk)
    out = out.withColumn("_c", F.explode(F.when(F.col("i") % chunk > chunk - size, F.array(at, at + 1)).otherwise(F.array(at))))
    last = Window.partitionBy(group, "_c").orderBy("i").rowsBetween(-(size - 1), 0)
    ordered = F.sort_array(F.collect_list(value).over(last))
    out = out.withColumns(
        {
            "median": F.element_at(ordered, F.floor((F.size(ordered) + 1) / 2).cast("int")),
            "mean": F.avg(value).over(last),
            "maximum": F.max(value).over(last),
            "global_mean": F.col("_sum") / F.col("_n"),
        }
    )
    return out.where(F.col("_c") == at).drop("_c", "_sum", "_n", "i")


def substituted(rows: DataFrame, group: str, order: list[str], value: str, size: int = 20) -> DataFrame:
    """Values with each non-finite one replaced by the running lower median, which includes earlier replacements: an ordered recursion, so one pass for each group."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        held: list[float] = []
        out = []
        for v in part[value].to_numpy(float):
            if not np.isfinite(v):
                v = sorted(held)[(len(held) - 1) // 2] if held else 0.0
            held = [*held, v][-size:]
            out.append(v)
        return part.assign(**{value: out})

    return rows.groupBy(group).applyInPandas(run, rows.schema)


def retained(rows: DataFrame, group: str, iteration: str, keep: int = 3) -> DataFrame:
    """The last `keep` of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(iteration)))).where(F.col("_r") <= keep).drop("_r")


def changes(rows: DataFrame, group: str, order: list[str], keys: list[str]) -> DataFrame:
    """Rows whose keys differ from those of the row before."""
    before = F.lag(F.struct(*keys)).over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.struct(*keys))).drop("_b")


def every(rows: DataFrame, ordinal: str, n: int, last: int) -> DataFrame:
    """Each n-th row and the last one."""
    return rows.where((F.col(ordinal) % n == 0) | (F.col(ordinal) == last))
