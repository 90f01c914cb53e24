"""Composite scores, thresholds and multi-label sampling buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.config import DEFAULTS
from lamina.functions.documents import mask, memberships

SCORES = {"bridge": "bridge_score", "architecture_bridge": "architecture_bridge_score", "architecture_specific": "architecture_specific_score", "rare_clean": "rare_clean_score", "tissue_specific": "tissue_specific_score"}
CATEGORY_COLUMNS = {"architecture": "architecture_score", "tissue_compartment": "compartment_score", "pathology_state": "pathology_score", "cellular_nuclear": "cellular_score", "scale_context": "scale_context_score"}


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two tables that must have the same keys, each once; anything else is an error."""
    broken = unmatched(left, right, keys).first().asDict()
    if any(broken.values()):
        raise ValueError(f"the tables do not match one to one: {broken}")
    return left.join(right, keys)


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys of one side only, and keys that a side has more than once."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, keys, "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"), F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated"))


def composite(clusters: DataFrame, weights: dict[str, float] | None = None, use_artifact_score: bool = True) -> DataFrame:
    """Adds cleanliness, the weighted semantic score and the seven composite scores."""
    weights = weights or DEFAULTS["semantic"]["weights"]
    useful = sum((F.lit(w) * F.col(CATEGORY_COLUMNS[c]) for c, w in weights.items()), F.lit(0.0))
    e, c, p = F.col("tissue_entropy"), F.col("tissue_coverage_norm"), F.col("patient_support")
    k, clean, arch = F.col("cleanliness"), F.col("clean_score"), F.col("architecture_score")
    out = clusters.withColumn("cleanliness", (1 - F.col("artifact_score")) if use_artifact_score else F.lit(1.0)).withColumn("useful_score", useful)
    out = out.withColumn("clean_score", F.col("useful_score") * k)
    return out.withColumns(
        {
            "bridge_score": clean * e * c * p,
            "architecture_bridge_score": arch * e * c * p * k,
            "architecture_specific_score": arch * (1 - e) * p * k,
            "rare_clean_score": F.col("rarity_score") * clean * p * k,
            "tissue_specific_score": clean * (1 - e) * p,
        }
    )


def eligibility(clusters: DataFrame, rules: dict | None = None) -> DataFrame:
    rules = rules or DEFAULTS["buckets"]
    artifact = (F.col("artifact_score") > rules["artifact_exclude"]) if rules["exclude_artifacts"] else F.lit(False)
    out = clusters.withColumn("is_artifact_excluded", artifact).withColumn("is_support_excluded", F.col("n_patients") < rules["support_exclude_patients"])
    return out.withColumn("sampling_eligible", ~F.col("is_artifact_excluded") & ~F.col("is_support_excluded"))


def thresholds(clusters: DataFrame, quantile: float = 0.8) -> DataFrame:
    """magnification and the exact quantile of each score over its eligible clusters (null if there is none)."""
    return clusters.groupBy("magnification").agg(*[F.percentile(F.when(F.col("sampling_eligible"), F.col(s)), quantile).alias(f"{s}_threshold") for s in SCORES.values()])


def meets(score: str) -> Column:
    return F.coalesce(F.col(score) >= F.col(f"{score}_threshold"), F.lit(False))


def assigned(clusters: DataFrame, rules: dict | None = None) -> DataFrame:
    """Adds eligibility, thresholds, a flag for each bucket, memberships, reasons of exclusion and the bit mask."""
    rules = rules or DEFAULTS["buckets"]
    out = eligibility(clusters, rules)
    mag = Window.partitionBy("magnification")  # clusters of a magnification are as many as configured
    out = out.withColumns({f"{s}_threshold": F.percentile(F.when(F.col("sampling_eligible"), F.col(s)), rules["top_quantile"]).over(mag) for s in SCORES.values()})

    def bucket(name: str) -> Column:
        r = rules[name]
        good = F.col("sampling_eligible") & meets(SCORES[name])
        if rules["exclude_artifacts"] and "artifact" in r:
            good &= F.col("artifact_score") < r["artifact"]
        if "patients" in r:
            good &= F.col("n_patients") >= r["patients"]
        if "coverage" in r:
            good &= F.col("tissue_coverage") >= r["coverage"]
        if "score" in r:
            good &= F.col("architecture_score") >= r["score"]
        if "entropy" in r:
            good &= F.col("tissue_entropy") <= r["entropy"]
        return good

    flags = {n: bucket(n) for n in SCORES}
    out = out.withColumns({f"is_{n}": f for n, f in flags.items()}).withColumn("is_random_eligible", F.col("sampling_eligible"))
    named = {n: F.col(f"is_{n}") for n in SCORES}
    return out.withColumns(
        {
            "bucket_memberships": memberships(named | {"random": F.col("is_random_eligible")}),
            "exclusion_reasons": memberships({"artifact": F.col("is_artifact_excluded"), "support": F.col("is_support_excluded")}),
            "bucket_mask": mask(named | {"random": F.col("is_random_eligible")}),
        }
    )


def hierarchy_document(clusters: DataFrame) -> DataFrame:
    """magnification, coarse_cluster_id, sorted fine ids, and the fine ids of each bucket."""
    ids = F.array_sort(F.collect_list("fine_cluster_id"))
    by = {n: F.array_sort(F.collect_list(F.when(F.array_contains("bucket_memberships", n), F.col("fine_cluster_id")))).alias(n) for n in [*SCORES, "random"]}
    return clusters.groupBy("magnification", "coarse_cluster_id").agg(ids.alias("fine_cluster_ids"), *by.values())


def selection(clusters: DataFrame, per_bucket: int = 50, seed: int = 7) -> DataFrame:
    """magnification, bucket, fine id, rank: the best clusters of each bucket; the random bucket by keyed hash order."""
    rows = [F.struct(F.lit(n).alias("bucket"), F.col(f"is_{n}").alias("flag"), (-F.col(s)).alias("order")) for n, s in SCORES.items()]
    rows.append(F.struct(F.lit("artifact").alias("bucket"), F.lit(True).alias("flag"), (-F.col("artifact_score")).alias("order")))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("magnification").cast("string"), F.col("fine_cluster_id").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double")
    rows.append(F.struct(F.lit("random").alias("bucket"), F.col("sampling_eligible").alias("flag"), number.alias("order")))
    each = clusters.select("magnification", "fine_cluster_id", F.explode(F.array(*rows)).alias("r")).select("magnification", "fine_cluster_id", "r.*").where("flag")
    rank = F.row_number().over(Window.partitionBy("magnification", "bucket").orderBy("order", "fine_cluster_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= per_bucket).select("magnification", "bucket", "fine_cluster_id", "rank")


def dominance(clusters: DataFrame, tiles: DataFrame, fields: list[str]) -> DataFrame:
    """For each bucket and field the most common value among the bucket's tiles (lowest value of equals) and its share."""
    members = clusters.select("magnification", "fine_cluster_id", F.explode("bucket_memberships").alias("bucket"))
    cells = tiles.groupBy("magnification", "fine_cluster_id", *fields).agg(F.count(F.lit(1)).alias("n"))  # before fields and buckets multiply them
    counted = cells.select("magnification", "fine_cluster_id", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("x")).select("magnification", "fine_cluster_id", "n", "x.*")
    counted = counted.groupBy("magnification", "fine_cluster_id", "field", "value").agg(F.sum("n").alias("n"))
    by = counted.join(F.broadcast(members), ["magnification", "fine_cluster_id"]).groupBy("magnification", "bucket", "field", "value").agg(F.sum("n").alias("n"))
    best = F.min_by("value", F.struct(-F.col("n"), F.col("value")))
    return by.groupBy("magnification", "bucket", "field").agg(F.sum("n").alias("n_tiles"), best.alias("dominant"), (F.max("n") / F.sum("n")).alias("dominant_fraction"))
