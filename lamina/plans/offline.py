"""The offline run: eight stages from tiles to validation, each a table on disk, gated by the manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.documents import canonical_hash
from lamina.operators import buckets, checks, clusters, index, semantic
from lamina.plans.manifest import Manifest, ManifestError, run_stages
from lamina.session import Storage
from lamina.sources import writers

STAGES = ["tile_index", "centroids", "semantic", "statistics", "composite", "buckets", "audit", "validation"]
OWNER = ".lamina-run"


def owned(storage: Storage, folder: str) -> str:
    """The run folder; one that exists without our mark is never touched."""
    place = folder.rstrip("/")
    mark = f"{place}/{OWNER}"
    if storage.occupied(place) and not storage.exists(mark):
        raise ManifestError(f"{folder} is not a run of this library")
    storage.make(place)
    if not storage.exists(mark):
        storage.write(mark, uuid.uuid4().hex)
    return place


def apart(storage: Storage, folders: list[str]) -> None:
    """No folder may lie in another."""
    places = [storage.resolved(f) for f in folders]
    for i, a in enumerate(places):
        for b in places[i + 1 :]:
            if a == b or a.startswith(b + "/") or b.startswith(a + "/"):
                raise ManifestError(f"{a} and {b} overlap")


@dataclass
class Inputs:
    """tiles: magnification, clusters, slide_id, patient_id, primary_site, tcga_project, packed_row_index; vectors: magnification, fine_cluster_id, coarse_cluster_id, vec_id, embedding; concepts."""

    tiles: DataFrame
    vectors: DataFrame
    concepts: DataFrame
    facts: dict = field(default_factory=dict)


def run(spark: SparkSession, folder: str, inputs: Inputs, config: dict, first: str | None = None, last: str | None = None, overwrite: bool = False) -> list[str]:
    """Runs what is due; returns the stages that ran. The folder must be one that every executor reaches."""
    storage = Storage(spark)
    place = owned(storage, folder)
    path = lambda name: f"{place}/{name}"
    read = lambda name: spark.read.parquet(path(name))
    fine, coarse = ["magnification", "fine_cluster_id"], ["magnification", "coarse_cluster_id"]
    manifest = Manifest(path("manifest.json"), STAGES, config, canonical_hash(inputs.facts), storage)

    def tile_index() -> dict:
        writers.partitioned(inputs.tiles, path("tiles"))
        return {"rows": read("tiles").count()}

    def centroids() -> None:
        parts = semantic.sums(inputs.vectors, [*fine, "coarse_cluster_id"])
        writers.staged(semantic.directions(semantic.rolled_up(parts, fine), fine), path("centroids"))
        writers.staged(semantic.directions(semantic.rolled_up(parts, coarse), coarse), path("coarse_centroids"))

    def scores() -> None:
        each = semantic.standardized(semantic.cosines(read("centroids"), inputs.concepts, fine), ["magnification", "concept_id"])
        writers.staged(each, path("concept_scores"))
        writers.staged(semantic.summary(read("concept_scores"), fine, config["semantic"]["category_top_k"]), path("semantic_summary"))

    def statistics() -> None:
        c = config["coverage"]
        for level in ("fine", "coarse"):
            writers.staged(clusters.statistics(read("tiles"), f"{level}_cluster_id", c["min_tiles"], c["min_patients"]), path(f"{level}_statistics"))

    def composite() -> None:
        joined = buckets.one_to_one(read("fine_statistics"), read("semantic_summary"), fine)
        writers.staged(buckets.composite(joined, config["semantic"]["weights"], config["semantic"]["use_artifact_score"]), path("composite"))

    def assign() -> None:
        writers.staged(buckets.assigned(read("composite"), config["buckets"]), path("buckets"))
        held = read("buckets").join(read("tiles").select("magnification", "fine_cluster_id", "coarse_cluster_id").distinct(), fine)
        writers.staged(buckets.hierarchy_document(held), path("hierarchy"))

    def audit() -> None:
        writers.staged(buckets.selection(read("buckets"), config["audit"]["clusters_per_bucket"], config["audit"]["seed"]), path("audit_selection"))
        writers.staged(buckets.dominance(read("buckets"), read("tiles"), ["primary_site", "tcga_project", "patient_id", "slide_id"]), path("dominance"))

    def validate() -> dict:
        found = checks.all_of(invariants(read, config)).collect()  # a row for each check
        storage.write(path("validation_report.json"), writers.json_text([r.asDict() for r in found]))
        return {"passed": all(r.passed for r in found)}

    work = dict(zip(STAGES, (tile_index, centroids, scores, statistics, composite, assign, audit, validate), strict=True))
    tables = {"tile_index": ["tiles"], "centroids": ["centroids", "coarse_centroids"], "semantic": ["concept_scores", "semantic_summary"], "statistics": ["fine_statistics", "coarse_statistics"], "composite": ["composite"], "buckets": ["buckets", "hierarchy"], "audit": ["audit_selection", "dominance"], "validation": ["validation_report.json"]}
    outputs = {s: [path(t) for t in ts] for s, ts in tables.items()}
    return run_stages(manifest, work, outputs, storage.exists, storage.remove, first, last, overwrite)


def invariants(read, config: dict) -> list[DataFrame]:
    """The checks of the last stage."""
    tiles, stats, scored, held = read("tiles"), read("fine_statistics"), read("concept_scores"), read("buckets")
    fine = ["magnification", "fine_cluster_id"]
    total = tiles.agg(F.count(F.lit(1)).alias("a")).crossJoin(stats.agg(F.sum("n_tiles").alias("b")))
    bank = scored.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct(*fine) * F.count_distinct("concept_id")).alias("m"))
    priority = F.greatest(*[F.col(f"is_{b}").cast("int") for b in buckets.SCORES]) == 1
    k = F.col("cleanliness")
    off = F.abs(F.col("clean_score") - F.col("useful_score") * k) > 1e-6
    off |= F.abs(F.col("rare_clean_score") - F.col("rarity_score") * F.col("clean_score") * F.col("patient_support") * k) > 1e-6
    from lamina.functions import vectors as V

    return [
        checks.check("tile_count", total, checks.count_where(F.col("a") != F.col("b"))),
        checks.check("centroid_norms", read("centroids"), checks.count_where(~V.is_unit(F.col("centroid"), 1e-4))),
        checks.same_keys("cluster_table_key_alignment", stats, held, fine),
        checks.check("semantic_score_row_count", bank, checks.count_where(F.col("n") != F.col("m"))),
        checks.check("semantic_scores_finite_and_bounded", scored, checks.count_where(~(F.col("raw_cosine").between(-1.0001, 1.0001) & F.col("percentile_score").between(0, 1) & ~F.isnan("z_score")))),
        checks.check("composite_formula_consistency", held, checks.count_where(off)),
        checks.check("excluded_clusters_not_prioritized", held, checks.count_where(~F.col("sampling_eligible") & priority)),
        checks.check("artifact_exclusion_switch_respected", held, checks.count_where(F.col("is_artifact_excluded") & F.lit(not config["buckets"]["exclude_artifacts"]))),
        checks.check("random_eligible_matches_eligibility", held, checks.count_where(F.col("is_random_eligible") != F.col("sampling_eligible"))),
        checks.check("representatives_of_known_clusters", read("audit_selection").join(held, fine, "left_anti").agg(F.count(F.lit(1)).alias("n")), checks.count_where(F.col("n") > 0)),
        checks.same_keys("centroid_key_alignment", stats, read("centroids"), fine),
        checks.check("coarse_centroid_norms", read("coarse_centroids"), checks.count_where(~V.is_unit(F.col("centroid"), 1e-4))),
        checks.same_keys("coarse_key_alignment", read("coarse_statistics"), read("coarse_centroids"), ["magnification", "coarse_cluster_id"]),
        checks.check("statistics_bounded", stats, checks.count_where(~(F.col("tissue_entropy").between(0, 1 + 1e-9) & F.col("tissue_coverage_norm").between(0, 1) & F.col("patient_support").between(0, 1 + 1e-9) & F.col("rarity_score").between(0.5, 3)))),
        checks.check("category_scores_bounded", read("semantic_summary"), checks.count_where(~F.greatest(*[F.col(c) for c in semantic.CATEGORY_SCORES.values()]).between(0, 1))),
        checks.check("support_exclusion_respected", held, checks.count_where(F.col("sampling_eligible") & (F.col("is_support_excluded") | F.col("is_artifact_excluded")))),
        checks.check("packed_rows_unique", tiles.groupBy("magnification", "packed_row_index").agg(F.count(F.lit(1)).alias("n")), checks.count_where(F.col("n") > 1)),
        checks.unique("coarse_to_fine_is_unique", tiles.select(*fine, "coarse_cluster_id").distinct(), fine),
        checks.check("audit_selection_nonempty", read("audit_selection").agg(F.count(F.lit(1)).alias("n")), checks.count_where(F.col("n") == 0)),
        checks.check("bucket_dominance_fractions_bounded", read("dominance"), checks.count_where(~F.col("dominant_fraction").between(0, 1))),
    ]


def compiled(spark: SparkSession, folder: str, tiles: DataFrame, masks: DataFrame, facts: Callable[[], dict]) -> dict:
    """The sampling index: one job for each magnification, whose result is kept for a resume. `facts` reads what identifies the source; it is called again before publishing, and a source that has changed meanwhile is refused."""
    storage = Storage(spark)
    place = owned(storage, folder)
    identity = canonical_hash(facts())
    masks = masks.where(F.col("bucket_mask").bitwiseAND(F.lit(1)) == 1)  # eligible clusters
    tiles = tiles.join(F.broadcast(masks.select("magnification", "fine_cluster_id")), ["magnification", "fine_cluster_id"], "left_semi")
    mags = sorted(r[0] for r in tiles.select("magnification").distinct().collect())  # the configured few
    storage.make(f"{place}/parts")
    for m in mags:
        done = f"{place}/parts/{m}.done"
        if storage.exists(done) and storage.read(done) == identity:
            continue
        part = tiles.where(F.col("magnification") == m)
        writers.staged(index.groups(part), f"{place}/parts/groups_{m}")
        storage.write(done, identity)
    groups = spark.read.parquet(*[f"{place}/parts/groups_{m}" for m in mags])
    slides = index.offsets(groups, ["slide_id"], "n_entries", "entry_start", "entry_end", index.CELL)
    writers.staged(slides, f"{place}/slide_groups")
    cells = groups.groupBy(*index.CELL).agg(F.count(F.lit(1)).alias("n_slides"), F.sum("n_entries").alias("n_entries"))
    records = index.offsets(cells, index.CELL[1:], "n_slides", "slide_start", "slide_end", ["magnification"]).join(F.broadcast(masks.select("magnification", "fine_cluster_id", "bucket_mask")), ["magnification", "fine_cluster_id"])
    writers.staged(records, f"{place}/fine_records")
    broken = index.violations(spark.read.parquet(f"{place}/fine_records"), spark.read.parquet(f"{place}/slide_groups")).first().asDict()
    if any(broken.values()):
        raise ManifestError(f"compiled index: {broken}")
    if canonical_hash(facts()) != identity:
        raise ManifestError("the source has changed while its index was compiled")
    contract = {"schema_version": 1, "source": identity, "magnifications": mags, "entries": groups.agg(F.sum("n_entries")).first()[0]}
    storage.write(f"{place}/manifest.json", json.dumps(contract, indent=2, sort_keys=True) + "\n")
    return contract
