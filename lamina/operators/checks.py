"""Data-quality checks: each is one row (name, passed, violations)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check(name: str, frame: DataFrame, violations: Column) -> DataFrame:
    """violations: an aggregate that counts them."""
    return frame.agg(violations.cast("long").alias("violations")).select(F.lit(name).alias("name"), (F.col("violations") == 0).alias("passed"), "violations")


def count_where(broken: Column) -> Column:
    return F.count_if(F.coalesce(broken, F.lit(True)))


def same_keys(name: str, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    both = left.select(*keys).withColumn("a", F.lit(1)).join(right.select(*keys).withColumn("b", F.lit(1)), keys, "full")
    return check(name, both, F.count_if(F.col("a").isNull() | F.col("b").isNull()))


def unique(name: str, frame: DataFrame, keys: list[str]) -> DataFrame:
    return check(name, frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), F.count_if(F.col("n") > 1))


def all_of(checks: list[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def inventory(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and its place: left only, right only, both."""
    both = left.select(key).distinct().withColumn("a", F.lit(1)).join(right.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return both.select(key, F.when(F.col("a").isNull(), "right_only").when(F.col("b").isNull(), "left_only").otherwise("both").alias("place"))


def coordinate_report(source: DataFrame, other: DataFrame, slide: str = "slide_id") -> DataFrame:
    """How two coordinate lists of each slide agree: counts, and whether they are equal, one a subset, or an ordered subset of the other."""
    a = source.select(slide, "x", "y", F.col("row").alias("row_a"))
    b = other.select(slide, "x", "y", F.col("row").alias("row_b"))
    both = a.join(b, [slide, "x", "y"], "full")
    w = Window.partitionBy(slide).orderBy("row_b")
    ordered = both.withColumn("back", F.when(F.col("row_a").isNotNull() & F.col("row_b").isNotNull(), F.col("row_a") < F.max(F.when(F.col("row_b").isNotNull(), F.col("row_a"))).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    out = ordered.groupBy(slide).agg(
        F.count_if(F.col("row_a").isNotNull() & F.col("row_b").isNotNull()).alias("common"),
        F.count_if(F.col("row_b").isNull()).alias("source_only"),
        F.count_if(F.col("row_a").isNull()).alias("other_only"),
        F.count_if(F.col("back")).alias("out_of_order"),
    )
    kind = F.when(F.col("other_only") > 0, "different").when((F.col("source_only") == 0) & (F.col("out_of_order") == 0), "exact").when(F.col("out_of_order") == 0, "ordered_subset").otherwise("subset")
    return out.withColumn("correspondence", kind)


def validated_review(review: DataFrame, selection: DataFrame, binding: dict[str, str]) -> DataFrame:
    """One row: reviewed, missing, repeated, wrongly bound and rejected clusters of an audit selection. review: cluster_key, decision, reviewer and the binding's columns."""
    passing = F.lower(F.trim("decision")).isin("pass", "approved", "approve") & (F.trim("reviewer") != "")
    bound = F.lit(True)
    for c, v in binding.items():
        bound &= F.col(c) == v
    by = review.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(passing, F.lit(False)).cast("int")).alias("ok"), F.min(F.coalesce(bound, F.lit(False)).cast("int")).alias("bound"))
    both = selection.select("cluster_key").distinct().join(by, "cluster_key", "left")
    return both.agg(F.count("n").alias("reviewed"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("bound") == 0).alias("wrongly_bound"), F.count_if(F.col("ok") == 0).alias("rejected"))
