"""Scores of clusters against text concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import vectors as V

#: Categories and the columns that hold their scores.
CATEGORY_SCORES = {
    "architecture": "architecture_score",
    "tissue_compartment": "compartment_score",
    "pathology_state": "pathology_score",
    "cellular_nuclear": "cellular_score",
    "scale_context": "scale_context_score",
    "anatomical_structures": "anatomical_structures_score",
    "tissue_identity": "tissue_identity_score",
}
ARTIFACTS = "artifact_quality"


def sums(rows: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Sum of vectors and row count of each group, by dimension in long form: keys, dim, total, n. Partial sums are made before the shuffle."""
    return rows.select(*keys, F.posexplode(vector).alias("dim", "value")).groupBy(*keys, "dim").agg(F.sum(F.col("value").cast("double")).alias("total"), F.count(F.lit(1)).alias("n"))


def rolled_up(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of a coarser level from those of a finer one."""
    return parts.groupBy(*keys, "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def directions(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Unit mean direction of each group from its sums: keys, n, centroid."""
    length = F.sqrt(F.sum(F.col("total") * F.col("total")).over(Window.partitionBy(*keys)))
    unit = parts.withColumn("value", F.col("total") / F.when(length == 0, 1.0).otherwise(length))
    pairs = F.sort_array(F.collect_list(F.struct("dim", "value")))
    return unit.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(pairs, lambda p: p["value"]).alias("centroid"))


def cosines(clusters: DataFrame, concepts: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """Every cluster against every concept. Concepts are a bank of fixed size (hundreds), clusters at most the configured thousands."""
    bank = concepts.select("concept_id", "category", "polarity", F.col("embedding").alias("concept_vector"))
    out = clusters.select(*keys, "centroid").crossJoin(F.broadcast(bank))
    return out.select(*keys, "concept_id", "category", "polarity", F.round(V.dot(F.col("centroid"), V.normalized(F.col("concept_vector"))), digits).alias("raw_cosine"))


def standardized(scores: DataFrame, group: list[str]) -> DataFrame:
    """z-score (population deviation, 0 where it is 0) and average-rank percentile within each group."""
    w = Window.partitionBy(*group)
    spread = F.stddev_pop("raw_cosine").over(w)
    n = F.count(F.lit(1)).over(w)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*group, "raw_cosine"))
    rank = F.rank().over(w.orderBy("raw_cosine")) + (ties - 1) / 2
    return scores.withColumns(
        {
            "z_score": F.when(spread > 0, (F.col("raw_cosine") - F.avg("raw_cosine").over(w)) / spread).otherwise(F.lit(0.0)),
            "percentile_score": F.when(n == 1, F.lit(0.5)).otherwise((rank - 1) / (n - 1)),
        }
    )


def category_scores(scores: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """keys, category, score: mean of the k best percentiles; positive concepts, or any polarity for tissue identity."""
    scope = (F.col("polarity") == "positive") | (F.col("category") == "tissue_identity")
    best = F.slice(F.sort_array(F.collect_list("percentile_score"), False), 1, max(1, k))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)
    return scores.where(scope & F.col("category").isin(*CATEGORY_SCORES)).groupBy(*keys, "category").agg(mean.alias("score"))


def artifact_scores(scores: DataFrame, keys: list[str]) -> DataFrame:
    negative = (F.col("polarity") == "negative") & (F.col("category") == ARTIFACTS)
    return scores.groupBy(*keys).agg(F.max(F.when(negative, F.col("percentile_score"))).alias("artifact_score"))


def top_concepts(scores: DataFrame, keys: list[str], polarity: str, n: int = 5) -> DataFrame:
    """The n best concepts of a polarity as an array of structs, by percentile, then cosine, then id."""
    row = F.struct((-F.col("percentile_score")).alias("p"), (-F.col("raw_cosine")).alias("c"), F.col("concept_id").alias("id"))
    best = F.slice(F.array_sort(F.collect_list(row)), 1, n)
    shown = lambda x: F.struct(x["id"].alias("concept_id"), F.round(-x["p"], 6).alias("percentile"), F.round(-x["c"], 6).alias("cosine"))
    return scores.where(F.col("polarity") == polarity).groupBy(*keys).agg(F.transform(best, shown).alias("top_concepts"))


def summary(scores: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """One row for each cluster: its category scores and artifact score."""
    by = category_scores(scores, keys, k)
    wide = by.groupBy(*keys).agg(*[F.max(F.when(F.col("category") == c, F.col("score"))).alias(column) for c, column in CATEGORY_SCORES.items()])
    return wide.join(artifact_scores(scores, keys), keys)


def ensemble(prompts: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Unit mean vector of each group of prompts, with its member count."""
    return directions(sums(prompts, by, vector), by)
