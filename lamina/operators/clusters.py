"""Exact per-cluster statistics over tiles, for the fine or the coarse level.

Input columns: magnification, <level>_cluster_id, slide_id, patient_id,
primary_site, tcga_project. Every statistic starts from one pre-aggregation to
(cluster, site, patient, project, slide) or less, so tiles are shuffled once, as
partial counts. `statistics` writes it once, to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import cut


def counted(tiles: DataFrame) -> Column:
    """Aggregate: number of tiles, of single ones or of groups that carry n."""
    return F.sum("n") if "n" in tiles.columns else F.count(F.lit(1))


def slide_level(tiles: DataFrame, level: str) -> DataFrame:
    """n tiles of each cluster and slide. Statistics that all start here share one exchange, so tiles are read and shuffled once."""
    return tiles.groupBy("magnification", level, "slide_id", "patient_id", "primary_site", "tcga_project").agg(F.count(F.lit(1)).alias("n"))


def tile_counts(tiles: DataFrame, level: str) -> DataFrame:
    return tiles.groupBy("magnification", level).agg(counted(tiles).alias("n_tiles"))


def distinct_members(tiles: DataFrame, level: str, member: str, into: str) -> DataFrame:
    """Distinct members of each cluster, in two steps, so a cluster's members are spread."""
    pairs = tiles.groupBy("magnification", level, member).agg(counted(tiles).alias("n"))
    return pairs.groupBy("magnification", level).agg(F.count(F.when(F.col("n") > 0, F.col(member))).alias(into))


def long_counts(tiles: DataFrame, level: str, category: str) -> DataFrame:
    """n tiles and n_patients for each cluster and category that it has."""
    by = tiles.groupBy("magnification", level, category, "patient_id").agg(counted(tiles).alias("n"))
    return by.groupBy("magnification", level, category).agg(F.sum("n").alias("n"), F.count("patient_id").alias("n_patients"))


def entropy_of(n: Column, total: Column, kinds: Column) -> Column:
    """Aggregate: entropy of counts over ln(kinds); 0 for a single kind."""
    return F.when(F.max(kinds) <= 1, F.lit(0.0)).otherwise(-F.sum(F.when(n > 0, n / total * F.ln(n / total))) / F.ln(F.max(kinds))) + 0.0


def entropy(counts: DataFrame, level: str, category: str) -> DataFrame:
    """n_tiles and normalised entropy; the number of kinds is that of the magnification."""
    kinds = counts.groupBy("magnification").agg(F.count_distinct(category).alias("kinds"))
    total = F.sum("n").over(Window.partitionBy("magnification", level))
    return counts.withColumn("total", total).join(F.broadcast(kinds), "magnification").groupBy("magnification", level).agg(F.sum("n").alias("n_tiles"), entropy_of(F.col("n"), F.col("total"), F.col("kinds")).alias("entropy"))


def coverage(counts: DataFrame, level: str, category: str, min_tiles: int = 20, min_patients: int = 3) -> DataFrame:
    """Categories above both limits, over the greatest such number of the magnification and over all categories of it."""
    kinds = counts.groupBy("magnification").agg(F.count_distinct(category).alias("kinds"))
    by = counts.groupBy("magnification", level).agg(F.count_if((F.col("n") >= min_tiles) & (F.col("n_patients") >= min_patients)).alias("coverage"))
    most = F.max("coverage").over(Window.partitionBy("magnification"))
    by = by.withColumn("coverage_norm", F.when(most > 0, F.col("coverage") / most).otherwise(F.lit(0.0)))
    return by.join(F.broadcast(kinds), "magnification").withColumn("coverage_fraction", F.col("coverage") / F.col("kinds")).drop("kinds")


def support(n: Column, most: Column) -> Column:
    return F.when(most <= 0, F.lit(0.0)).otherwise(F.log1p(n) / F.log1p(most))


def rarity(n: Column, median: Column) -> Column:
    return F.least(F.greatest(F.sqrt(median / n), F.lit(0.5)), F.lit(3.0))


def dominant(counts: DataFrame, level: str, category: str) -> DataFrame:
    """Most frequent category (the lowest name of equals) and its share."""
    best = F.min_by(category, F.struct(-F.col("n"), F.col(category)))
    return counts.groupBy("magnification", level).agg(best.alias("dominant"), (F.max("n") / F.sum("n")).alias("dominant_fraction"), F.count_if(F.col("n") > 0).alias("kinds"))


def children(tiles: DataFrame) -> DataFrame:
    pairs = tiles.select("magnification", "coarse_cluster_id", "fine_cluster_id").distinct()
    return pairs.groupBy("magnification", "coarse_cluster_id").agg(F.count(F.lit(1)).alias("n_fine_clusters"))


def statistics(tiles: DataFrame, level: str = "fine_cluster_id", min_tiles: int = 20, min_patients: int = 3) -> DataFrame:
    """All statistics of a level, one row for each cluster."""
    keys = ["magnification", level]
    tiles = cut(slide_level(tiles, level))  # every branch below reads this table, tiles are read once
    sites, projects = long_counts(tiles, level, "primary_site"), long_counts(tiles, level, "tcga_project")
    mag = Window.partitionBy("magnification")
    out = entropy(sites, level, "primary_site").withColumnRenamed("entropy", "tissue_entropy")
    out = out.join(entropy(projects, level, "tcga_project").select(*keys, F.col("entropy").alias("project_entropy")), keys)
    out = out.join(coverage(sites, level, "primary_site", min_tiles, min_patients).withColumnsRenamed({"coverage": "tissue_coverage", "coverage_norm": "tissue_coverage_norm", "coverage_fraction": "tissue_coverage_fraction"}), keys)
    out = out.join(dominant(sites, level, "primary_site").select(*keys, F.col("dominant").alias("dominant_tissue"), F.col("dominant_fraction").alias("dominant_tissue_fraction"), F.col("kinds").alias("n_tissues")), keys)
    out = out.join(dominant(projects, level, "tcga_project").select(*keys, F.col("dominant").alias("dominant_project"), F.col("dominant_fraction").alias("dominant_project_fraction"), F.col("kinds").alias("n_projects")), keys)
    for member, into in (("patient_id", "n_patients"), ("slide_id", "n_slides")):
        out = out.join(distinct_members(tiles, level, member, into), keys)
    out = out.withColumns({f"{p}_support": support(F.col(f"n_{p}s"), F.max(f"n_{p}s").over(mag)) for p in ("patient", "slide")})
    return out.withColumn("rarity_score", rarity(F.col("n_tiles"), F.median("n_tiles").over(mag)))
