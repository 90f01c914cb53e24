"""Registered queries and their SQL equivalents."""

from __future__ import annotations

import copy
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.config import DEFAULTS
from lamina.functions import documents as D
from lamina.functions import images, schedules
from lamina.functions import text as X
from lamina.functions import vectors as V
from lamina.operators import buckets, checks, clusters, evaluation, index, kmeans, neighbours, provenance, relations, semantic, series
from lamina.plans import proxy as P
from lamina.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FINE, COARSE = "fine_cluster_id", "coarse_cluster_id"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def r6(name: str, into: str | None = None):
    return (F.round(F.col(name), 6) + 0.0).alias(into or name)


def s6(name: str, into: str | None = None) -> str:
    return f"round({name}, 6) + 0.0 AS {into or name}"


TILES = f"WITH {P.TILES}"

# --- tiles -----------------------------------------------------------------


@query(
    "p01_tile_fact",
    f"""{TILES}, {P.PACKED} SELECT slide_id || '|' || magnification || 'x|' || packed_row_index AS tile_id, CAST(slide_id AS VARCHAR) AS wsi_id, CAST(slide_id AS VARCHAR) AS slide_id, CAST(patient_id AS VARCHAR) AS patient_id,
  'f' || slide_id AS file_id, 'c' || patient_id AS case_id, tcga_project, primary_site, primary_site AS tissue_or_organ, lower(l_returnflag) AS disease_type, magnification, magnification || 'x' AS scale_bin, x, y,
  CAST(NULL AS FLOAT) AS mpp, 256 AS patch_size, CAST(256 * 40 / magnification AS INT) AS patch_size_level0, 40 AS level0_magnification, 'raw/' || slide_id || '.h5' AS raw_embedding_h5_path,
  'projected/' || slide_id || '.h5' AS projected_embedding_h5_path, packed_row_index % 1024 AS embedding_row_index, packed_row_index, fine_cluster_id, coarse_cluster_id, CAST(NULL AS VARCHAR) AS tile_path,
  'wsi/' || slide_id || '.svs' AS wsi_path, CAST(NULL AS FLOAT) AS quality_score, CAST(NULL AS FLOAT) AS tissue_ratio, CAST(NULL AS FLOAT) AS blur_score, 'none_semantic_artifact_only' AS quality_source FROM packed""",
)
def p01_tile_fact(spark, d):
    t = P.packed_rows(P.tiles(spark, d))
    s, m = F.col("slide_id").cast("string"), F.col("magnification").cast("string")
    none = F.lit(None)
    return t.select(
        F.concat_ws("|", s, F.concat(m, F.lit("x")), F.col("packed_row_index").cast("string")).alias("tile_id"),
        s.alias("wsi_id"), s.alias("slide_id"), F.col("patient_id").cast("string").alias("patient_id"), F.concat(F.lit("f"), s).alias("file_id"), F.concat(F.lit("c"), F.col("patient_id").cast("string")).alias("case_id"),
        "tcga_project", "primary_site", F.col("primary_site").alias("tissue_or_organ"), F.lower("l_returnflag").alias("disease_type") if "l_returnflag" in t.columns else F.lit("").alias("disease_type"),
        "magnification", F.concat(m, F.lit("x")).alias("scale_bin"), "x", "y", none.cast("float").alias("mpp"), F.lit(256).alias("patch_size"), (F.lit(256 * 40) / F.col("magnification")).cast("int").alias("patch_size_level0"),
        F.lit(40).alias("level0_magnification"), F.concat(F.lit("raw/"), s, F.lit(".h5")).alias("raw_embedding_h5_path"), F.concat(F.lit("projected/"), s, F.lit(".h5")).alias("projected_embedding_h5_path"),
        (F.col("packed_row_index") % 1024).alias("embedding_row_index"), "packed_row_index", FINE, COARSE, none.cast("string").alias("tile_path"), F.concat(F.lit("wsi/"), s, F.lit(".svs")).alias("wsi_path"),
        none.cast("float").alias("quality_score"), none.cast("float").alias("tissue_ratio"), none.cast("float").alias("blur_score"), F.lit("none_semantic_artifact_only").alias("quality_source"),
    )


@query(
    "f01_upsampled_split",
    """SELECT [5, 10, 20, 40][l_linenumber % 4 + 1] AS target, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 30 THEN 20 ELSE 40 END AS level0,
  CASE WHEN l_quantity < 10 THEN false ELSE [5, 10, 20, 40][l_linenumber % 4 + 1] > CASE WHEN l_quantity < 30 THEN 20 ELSE 40 END END AS excluded, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def f01_upsampled_split(spark, d):
    level0 = F.when(F.col("l_quantity") < 10, 0).when(F.col("l_quantity") < 30, 20).otherwise(40)
    rows = P.table(spark, d, "lineitem").select(P.magnification().alias("target"), level0.alias("level0"))
    return rows.withColumn("excluded", files.upsampled(F.col("target"), F.col("level0"))).groupBy("target", "level0", "excluded").agg(F.count(F.lit(1)).alias("n"))


def _allowed(spark, d, how):
    line = P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slide_id"), P.magnification().alias("magnification"), F.floor("l_extendedprice").cast("long").alias("x"), F.col("l_partkey").alias("y"), "l_quantity")
    keys = ["slide_id", "magnification", "x", "y"]
    return line.join(line.where("l_quantity >= 25").select(*keys), keys, how).groupBy("magnification").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum_x"))


ALLOWED = """WITH l AS (SELECT l_orderkey AS s, [5, 10, 20, 40][l_linenumber % 4 + 1] AS m, CAST(floor(l_extendedprice) AS BIGINT) AS x, l_partkey AS y, l_quantity FROM lineitem)
SELECT m AS magnification, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x FROM l WHERE {} EXISTS (SELECT 1 FROM l a WHERE a.l_quantity >= 25 AND a.s = l.s AND a.m = l.m AND a.x = l.x AND a.y = l.y) GROUP BY m"""


@query("j09_allowlist_semi", ALLOWED.format(""))
def j09_allowlist_semi(spark, d):
    return _allowed(spark, d, "left_semi")


@query("j09_allowlist_anti", ALLOWED.format("NOT"))
def j09_allowlist_anti(spark, d):
    return _allowed(spark, d, "left_anti")


@query(
    "j10_coordinate_compare",
    f"""WITH l AS (SELECT *, l_orderkey * 1048576 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(P.KEYS[1:])}) AS r FROM lineitem),
a AS (SELECT l_orderkey % 100 AS slide_id, r AS x, l_partkey AS y, r AS ra FROM l WHERE l_quantity < 45), b AS (SELECT l_orderkey % 100 AS slide_id, r AS x, l_partkey AS y, CASE WHEN l_orderkey % 3 = 0 AND l_orderkey % 100 < 50 THEN -r ELSE r END AS rb FROM l WHERE l_quantity >= 5),
f AS (SELECT slide_id, ra, rb FROM a FULL JOIN b USING (slide_id, x, y)),
o AS (SELECT *, max(CASE WHEN rb IS NOT NULL THEN ra END) OVER (PARTITION BY slide_id ORDER BY rb NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f),
c AS (SELECT slide_id, count(*) FILTER (ra IS NOT NULL AND rb IS NOT NULL) AS common, count(*) FILTER (rb IS NULL) AS source_only, count(*) FILTER (ra IS NULL) AS other_only, count(*) FILTER (rb IS NOT NULL AND ra < before) AS out_of_order FROM o GROUP BY slide_id)
SELECT *, CASE WHEN other_only > 0 THEN 'different' WHEN source_only = 0 AND out_of_order = 0 THEN 'exact' WHEN out_of_order = 0 THEN 'ordered_subset' ELSE 'subset' END AS correspondence FROM c""",
)
def j10_coordinate_compare(spark, d):
    """Line items of an order are numbered with room for a million of them; in half of the slides a third of the orders stands backwards."""
    r = F.col("l_orderkey") * 1048576 + F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*P.KEYS[1:]))
    line = P.table(spark, d, "lineitem").withColumn("r", r).select("l_orderkey", (F.col("l_orderkey") % 100).alias("slide_id"), F.col("r").alias("x"), F.col("l_partkey").alias("y"), F.col("r").alias("row"), "l_quantity")
    back = (F.col("l_orderkey") % 3 == 0) & (F.col("l_orderkey") % 100 < 50)
    return checks.coordinate_report(line.where("l_quantity < 45"), line.where("l_quantity >= 5").withColumn("row", F.when(back, -F.col("row")).otherwise(F.col("row"))))


@query(
    "j06_range_shard",
    """WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), o AS (SELECT l_orderkey, n, sum(n) OVER (ORDER BY l_orderkey) - n AS row_start FROM s)
SELECT CAST(row_start + i AS BIGINT) AS packed_row, l_orderkey AS slide_id, i AS row_in_shard FROM (SELECT *, unnest(range(n)) AS i FROM o)""",
)
def j06_range_shard(spark, d):
    """Every position to its shard: shards are numbered by running sums, positions and shards meet in equal ranges of rows, and the bounds decide."""
    line = P.table(spark, d, "lineitem")
    shards = line.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.floor(F.col("l_orderkey") / 1024))
    shards = index.offsets(shards, ["l_orderkey"], "n", "row_start", "row_end", ["g"])
    cell = 256
    shards = shards.withColumn("cell", F.explode(F.sequence(F.floor(F.col("row_start") / cell), F.floor((F.col("row_end") - 1) / cell))))
    asked = spark.range(line.count()).select(F.col("id").alias("packed_row")).withColumn("cell", F.floor(F.col("packed_row") / cell))
    out = asked.join(shards, "cell").where((F.col("packed_row") >= F.col("row_start")) & (F.col("packed_row") < F.col("row_end")))
    return out.select("packed_row", F.col("l_orderkey").alias("slide_id"), (F.col("packed_row") - F.col("row_start")).alias("row_in_shard"))


# --- statistics ------------------------------------------------------------


@query("a01_tile_counts", f"{TILES} SELECT magnification, fine_cluster_id, count(*) AS n_tiles FROM tiles GROUP BY ALL")
def a01_tile_counts(spark, d):
    return clusters.tile_counts(P.tiles(spark, d), FINE)


@query("a02_slide_counts", f"{TILES} SELECT magnification, fine_cluster_id, count(DISTINCT slide_id) AS n_slides FROM tiles GROUP BY ALL")
def a02_slide_counts(spark, d):
    return clusters.distinct_members(P.tiles(spark, d), FINE, "slide_id", "n_slides")


@query("a03_patient_counts", f"{TILES} SELECT magnification, fine_cluster_id, count(DISTINCT patient_id) AS n_patients FROM tiles GROUP BY ALL")
def a03_patient_counts(spark, d):
    return clusters.distinct_members(P.tiles(spark, d), FINE, "patient_id", "n_patients")


@query("a04_long_counts", f"{TILES} SELECT magnification, fine_cluster_id, primary_site, count(*) AS n, count(DISTINCT patient_id) AS n_patients FROM tiles GROUP BY ALL")
def a04_long_counts(spark, d):
    return clusters.long_counts(P.tiles(spark, d), FINE, "primary_site")


def _entropy(level):
    def run(spark, d):
        counts = clusters.long_counts(P.tiles(spark, d), level, "primary_site")
        out = clusters.entropy(counts, level, "primary_site").join(clusters.coverage(counts, level, "primary_site"), ["magnification", level])
        return out.select("magnification", level, "n_tiles", r6("entropy", "tissue_entropy"), F.col("coverage").alias("tissue_coverage"), r6("coverage_norm", "tissue_coverage_norm"), r6("coverage_fraction", "tissue_coverage_fraction"))

    return run


for _name, _level in (("a05_cluster_entropy", FINE), ("a05_coarse_entropy", COARSE)):
    query(_name, f"{TILES}, {P.stats_sql(_level)} SELECT magnification, {_level}, CAST(n_tiles AS BIGINT) AS n_tiles, {s6('tissue_entropy')}, tissue_coverage, {s6('tissue_coverage_norm')}, {s6('tissue_coverage_fraction')} FROM stats")(_entropy(_level))

STAT_COLUMNS = ["tissue_entropy", "project_entropy", "tissue_coverage_norm", "tissue_coverage_fraction", "dominant_tissue_fraction", "dominant_project_fraction", "patient_support", "slide_support", "rarity_score"]
STAT_COUNTS = ["n_tiles", "n_patients", "n_slides", "n_tissues", "n_projects", "tissue_coverage"]


def _stats(level):
    def run(spark, d):
        out = clusters.statistics(P.tiles(spark, d), level)
        return out.select("magnification", level, *STAT_COUNTS, *map(r6, STAT_COLUMNS), "dominant_tissue", "dominant_project")

    return run


for _name, _level in (("a10_fine_statistics", FINE), ("a10_coarse_statistics", COARSE)):
    query(_name, f"{TILES}, {P.stats_sql(_level)} SELECT magnification, {_level}, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in STAT_COUNTS)}, {', '.join(map(s6, STAT_COLUMNS))}, dominant_tissue, dominant_project FROM stats")(_stats(_level))


@query("a07_support", f"{TILES}, {P.stats_sql(FINE)} SELECT magnification, fine_cluster_id, {s6('patient_support')}, {s6('slide_support')} FROM stats")
def a07_support(spark, d):
    t, keys, mag = P.tiles(spark, d), ["magnification", FINE], Window.partitionBy("magnification")
    out = clusters.distinct_members(t, FINE, "patient_id", "p").join(clusters.distinct_members(t, FINE, "slide_id", "s"), keys)
    out = out.withColumns({"patient_support": clusters.support(F.col("p"), F.max("p").over(mag)), "slide_support": clusters.support(F.col("s"), F.max("s").over(mag))})
    return out.select(*keys, r6("patient_support"), r6("slide_support"))


@query("a08_rarity", f"{TILES}, n AS (SELECT magnification, fine_cluster_id, count(*) AS n FROM tiles GROUP BY ALL) SELECT magnification, fine_cluster_id, round(least(greatest(sqrt(median(n) OVER (PARTITION BY magnification) / n), 0.5), 3.0), 6) AS rarity_score FROM n")
def a08_rarity(spark, d):
    out = clusters.tile_counts(P.tiles(spark, d), FINE)
    return out.select("magnification", FINE, F.round(clusters.rarity(F.col("n_tiles"), F.median("n_tiles").over(Window.partitionBy("magnification"))), 6).alias("rarity_score"))


@query("a09_dominant", f"{TILES}, {P.stats_sql(FINE)} SELECT magnification, fine_cluster_id, dominant_tissue AS dominant, {s6('dominant_tissue_fraction', 'dominant_fraction')}, n_tissues AS kinds FROM stats")
def a09_dominant(spark, d):
    out = clusters.dominant(clusters.long_counts(P.tiles(spark, d), FINE, "primary_site"), FINE, "primary_site")
    return out.select("magnification", FINE, "dominant", r6("dominant_fraction"), "kinds")


@query("a11_children", f"{TILES} SELECT magnification, coarse_cluster_id, count(DISTINCT fine_cluster_id) AS n_fine_clusters FROM tiles GROUP BY ALL")
def a11_children(spark, d):
    return clusters.children(P.tiles(spark, d))


@query("p18_distribution", f"{TILES}, c AS (SELECT magnification, fine_cluster_id, primary_site, count(*) AS n FROM tiles GROUP BY ALL) SELECT magnification, fine_cluster_id, row_number() OVER (PARTITION BY magnification, fine_cluster_id ORDER BY n DESC, primary_site) AS place, primary_site AS name, n FROM c")
def p18_distribution(spark, d):
    counts = P.tiles(spark, d).groupBy("magnification", FINE, "primary_site").agg(F.count(F.lit(1)).alias("n"))
    by = counts.groupBy("magnification", FINE).agg(D.distribution(F.col("primary_site"), F.col("n")).alias("x"))
    return by.select("magnification", FINE, F.posexplode("x").alias("place", "v")).select("magnification", FINE, (F.col("place") + 1).cast("long").alias("place"), "v.name", "v.n")


@query("a21_summary", f"{TILES} SELECT magnification, count(*) AS n_tiles, count(DISTINCT slide_id) AS n_slides, CAST(max(fine_cluster_id) + 1 AS INT) AS fine_clusters, round(count(*) / (SELECT count(*) FROM tiles), 6) AS share FROM tiles GROUP BY ALL")
def a21_summary(spark, d):
    t = P.tiles(spark, d)
    by = t.groupBy("magnification", "slide_id").agg(F.count(F.lit(1)).alias("n"), F.max(FINE).alias("m")).groupBy("magnification").agg(F.sum("n").alias("n_tiles"), F.count(F.lit(1)).alias("n_slides"), (F.max("m") + 1).alias("fine_clusters"))
    return by.withColumn("share", F.round(F.col("n_tiles") / F.sum("n_tiles").over(Window.partitionBy()), 6))


# --- vectors ---------------------------------------------------------------


@query("f05_norm_check", "WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings) SELECT count(*) AS n, count(*) FILTER (abs(norm - 1) > 1e-3) AS not_unit, count(*) FILTER (norm <= 1e-12) AS zero, CAST(0 AS BIGINT) AS not_finite, round(min(norm), 5) AS low, round(max(norm), 5) AS high FROM n")
def f05_norm_check(spark, d):
    e = P.vectors(spark, d).select("embedding", V.norm(F.col("embedding")).alias("norm"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("norm") - 1) > 1e-3).alias("not_unit"), F.count_if(F.col("norm") <= V.TINY).alias("zero"), F.count_if(~V.finite(F.col("embedding"))).alias("not_finite"), F.round(F.min("norm"), 5).alias("low"), F.round(F.max("norm"), 5).alias("high"))


SEM = f"WITH {P.SEMANTIC}"


@query("a12_centroids", f"{SEM} SELECT fine_cluster_id, CAST(dim AS INT) AS dim, n, round(v, 6) + 0.0 AS value FROM cent")
def a12_centroids(spark, d):
    out = semantic.directions(semantic.sums(P.vectors(spark, d), [FINE]), [FINE])
    return out.select(FINE, "n", F.posexplode("centroid").alias("dim", "value")).select(FINE, "dim", "n", r6("value"))


@query("a13_coarse_centroids", f"{SEM}, c AS (SELECT fine_cluster_id % 3 AS coarse_cluster_id, dim, sum(total) AS total, sum(n) AS n FROM sums GROUP BY ALL) SELECT coarse_cluster_id, CAST(dim AS INT) AS dim, CAST(n AS BIGINT) AS n, round(total / sqrt(sum(total * total) OVER (PARTITION BY coarse_cluster_id)), 6) + 0.0 AS value FROM c")
def a13_coarse_centroids(spark, d):
    parts = semantic.sums(P.vectors(spark, d), [FINE, COARSE])
    out = semantic.directions(semantic.rolled_up(parts, [COARSE]), [COARSE])
    return out.select(COARSE, "n", F.posexplode("centroid").alias("dim", "value")).select(COARSE, "dim", "n", r6("value"))


@query("p10_self_distance", f"{SEM}, e AS (SELECT vec_id, label AS fine_cluster_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT vec_id, fine_cluster_id, round(-sum((e.v - cent.v) * (e.v - cent.v)), 6) + 0.0 AS score FROM e JOIN cent USING (fine_cluster_id, dim) GROUP BY ALL")
def p10_self_distance(spark, d):
    e = P.vectors(spark, d)
    c = semantic.directions(semantic.sums(e, [FINE]), [FINE])
    return e.join(c, FINE).select("vec_id", FINE, (F.round(V.negative_squared_distance(F.col("embedding"), F.col("centroid")), 6) + 0.0).alias("score"))


@query(
    "w02_representatives",
    f"""{SEM}, e AS (SELECT vec_id, label AS fine_cluster_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
s AS (SELECT vec_id, fine_cluster_id, vec_id % 7 AS slide, round(-sum((e.v - cent.v) * (e.v - cent.v)), 9) AS score FROM e JOIN cent USING (fine_cluster_id, dim) GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY fine_cluster_id, slide ORDER BY score DESC, vec_id) AS r1 FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY fine_cluster_id ORDER BY score DESC, vec_id) AS rank FROM a WHERE r1 <= 2)
SELECT fine_cluster_id AS cluster, slide, vec_id AS "row", round(score, 6) AS score, CAST(rank AS INT) AS rank FROM b WHERE rank <= 20""",
)
def w02_representatives(spark, d):
    e = P.vectors(spark, d)
    c = semantic.directions(semantic.sums(e, [FINE]), [FINE])
    rows = e.join(c, FINE).select(F.col(FINE).alias("cluster"), (F.col("vec_id") % 7).alias("slide"), F.col("vec_id").alias("row"), F.round(V.negative_squared_distance(F.col("embedding"), F.col("centroid")), 9).alias("score"))
    return neighbours.representatives(rows).withColumn("score", F.round("score", 6))


def _scored(spark, d):
    c = semantic.directions(semantic.sums(P.vectors(spark, d), [FINE]), [FINE])
    return semantic.standardized(semantic.cosines(c, P.concepts(spark, d), [FINE]), ["concept_id"])


@query("j11_concept_cosine", f"{SEM} SELECT fine_cluster_id, concept_id, category, polarity, {s6('raw_cosine')} FROM scored")
def j11_concept_cosine(spark, d):
    c = semantic.directions(semantic.sums(P.vectors(spark, d), [FINE]), [FINE])
    return semantic.cosines(c, P.concepts(spark, d), [FINE]).withColumn("raw_cosine", r6("raw_cosine"))


@query("a14_zscore", f"{SEM} SELECT fine_cluster_id, concept_id, {s6('z_score')} FROM scored")
def a14_zscore(spark, d):
    return _scored(spark, d).select(FINE, "concept_id", r6("z_score"))


@query("w01_percentile", f"{SEM} SELECT fine_cluster_id, concept_id, {s6('percentile_score')} FROM scored")
def w01_percentile(spark, d):
    return _scored(spark, d).select(FINE, "concept_id", r6("percentile_score"))


@query("a15_category_topk", f"{SEM} SELECT fine_cluster_id, category, {s6('score')} FROM catscore")
def a15_category_topk(spark, d):
    return semantic.category_scores(_scored(spark, d), [FINE]).select(FINE, "category", r6("score"))


@query("a16_artifact", f"{SEM} SELECT fine_cluster_id, {s6('artifact_score')} FROM art")
def a16_artifact(spark, d):
    return semantic.artifact_scores(_scored(spark, d), [FINE]).select(FINE, r6("artifact_score"))


@query("p19_top_concepts", f"{SEM}, r AS (SELECT *, row_number() OVER (PARTITION BY fine_cluster_id ORDER BY percentile_score DESC, raw_cosine DESC, concept_id) AS place FROM scored WHERE polarity = 'positive') SELECT fine_cluster_id, place, concept_id, round(percentile_score, 6) AS percentile, round(raw_cosine, 6) AS cosine FROM r WHERE place <= 5")
def p19_top_concepts(spark, d):
    out = semantic.top_concepts(_scored(spark, d), [FINE], "positive")
    return out.select(FINE, F.posexplode("top_concepts").alias("place", "x")).select(FINE, (F.col("place") + 1).cast("long").alias("place"), "x.*")


@query("a19_ensemble", "WITH e AS (SELECT label, vec_id % 4 AS template, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT label, template, dim, sum(v) AS t, count(*) AS n FROM e GROUP BY ALL) SELECT label, template, CAST(dim AS INT) AS dim, n, round(t / sqrt(sum(t * t) OVER (PARTITION BY label, template)), 6) + 0.0 AS value FROM s")
def a19_ensemble(spark, d):
    e = P.table(spark, d, "embeddings").withColumn("template", F.col("vec_id") % 4)
    out = semantic.ensemble(e, ["label", "template"])
    return out.select("label", "template", "n", F.posexplode("centroid").alias("dim", "value")).select("label", "template", "dim", "n", r6("value"))


# --- composite, buckets, audit ----------------------------------------------

RELAXED = copy.deepcopy(DEFAULTS["buckets"])
RELAXED["architecture_specific"]["entropy"] = RELAXED["tissue_specific"]["entropy"] = 0.99


def _composite(spark, d):
    stats = clusters.statistics(P.tiles(spark, d))
    summary = semantic.summary(_scored(spark, d), [FINE]).withColumnRenamed(FINE, "label")
    out = buckets.composite(stats.join(F.broadcast(summary), F.col(FINE) % 10 == F.col("label")))  # a row for each cluster of the bank
    return out.withColumns({c: F.round(c, 9) for c in ["clean_score", *buckets.SCORES.values()]})


COMP = f"{TILES}, {P.stats_sql(FINE)}, {P.SEMANTIC}, {P.composite_sql(0.99)}"
COMPOSITE_COLUMNS = ["cleanliness", "useful_score", "clean_score", *P.SCORE_NAMES]


@query("j01_composite", f"{COMP} SELECT magnification, fine_cluster_id, {', '.join(map(s6, COMPOSITE_COLUMNS))} FROM comp")
def j01_composite(spark, d):
    return _composite(spark, d).select("magnification", FINE, *map(r6, COMPOSITE_COLUMNS))


@query("a17_thresholds", f"{COMP} SELECT magnification, {', '.join(s6(f'{s}_threshold') for s in P.SCORE_NAMES)} FROM thr")
def a17_thresholds(spark, d):
    return buckets.thresholds(buckets.eligibility(_composite(spark, d))).select("magnification", *[r6(f"{s}_threshold") for s in P.SCORE_NAMES])


FLAGS = ["is_artifact_excluded", "is_support_excluded", "sampling_eligible", "is_bridge", "is_architecture_bridge", "is_architecture_specific", "is_rare_clean", "is_tissue_specific"]


def _assigned(spark, d):
    return buckets.assigned(_composite(spark, d), RELAXED)


@query("f08_buckets", f"{COMP} SELECT magnification, fine_cluster_id, {', '.join(FLAGS)} FROM bucketed")
def f08_buckets(spark, d):
    return _assigned(spark, d).select("magnification", FINE, *FLAGS)


MEMBERS = "list_filter([CASE WHEN is_bridge THEN 'bridge' END, CASE WHEN is_architecture_bridge THEN 'architecture_bridge' END, CASE WHEN is_architecture_specific THEN 'architecture_specific' END, CASE WHEN is_rare_clean THEN 'rare_clean' END, CASE WHEN is_tissue_specific THEN 'tissue_specific' END, CASE WHEN sampling_eligible THEN 'random' END], lambda x: x IS NOT NULL)"
MASKS = "CAST(CASE WHEN sampling_eligible THEN 1 ELSE 0 END + CASE WHEN is_bridge THEN 2 ELSE 0 END + CASE WHEN is_architecture_bridge THEN 4 ELSE 0 END + CASE WHEN is_rare_clean THEN 8 ELSE 0 END + CASE WHEN is_tissue_specific THEN 16 ELSE 0 END + CASE WHEN is_architecture_specific THEN 32 ELSE 0 END AS INT)"


@query("p20_memberships", f"{COMP} SELECT magnification, fine_cluster_id, array_to_string({MEMBERS}, ',') AS memberships, CASE WHEN is_artifact_excluded AND is_support_excluded THEN 'artifact,support' WHEN is_artifact_excluded THEN 'artifact' WHEN is_support_excluded THEN 'support' ELSE '' END AS reasons FROM bucketed")
def p20_memberships(spark, d):
    return _assigned(spark, d).select("magnification", FINE, F.array_join("bucket_memberships", ",").alias("memberships"), F.array_join("exclusion_reasons", ",").alias("reasons"))


@query("p21_masks", f"{COMP} SELECT magnification, fine_cluster_id, {MASKS} AS bucket_mask, {MASKS} & 8 = 8 AS has_rare_clean FROM bucketed")
def p21_masks(spark, d):
    return _assigned(spark, d).select("magnification", FINE, "bucket_mask", D.has_bit(F.col("bucket_mask"), "rare_clean").alias("has_rare_clean"))


AUDITED = " UNION ALL ".join(f"SELECT magnification, '{b}' AS bucket, fine_cluster_id, -{s} AS o FROM bucketed WHERE is_{b}" for b, s in buckets.SCORES.items()) + " UNION ALL SELECT magnification, 'artifact', fine_cluster_id, -artifact_score FROM bucketed UNION ALL SELECT magnification, 'random', fine_cluster_id, CAST(CAST('0x' || substr(md5('7:' || magnification || ':' || fine_cluster_id), 1, 12) AS BIGINT) AS DOUBLE) FROM bucketed WHERE sampling_eligible"


@query("w03_audit_selection", f"{COMP}, a AS ({AUDITED}), r AS (SELECT *, row_number() OVER (PARTITION BY magnification, bucket ORDER BY o, fine_cluster_id) AS rank FROM a) SELECT magnification, bucket, fine_cluster_id, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def w03_audit_selection(spark, d):
    return buckets.selection(_assigned(spark, d), per_bucket=10)


@query(
    "a18_dominance",
    f"""{COMP}, m AS (SELECT magnification, fine_cluster_id, unnest({MEMBERS}) AS bucket FROM bucketed),
v AS (SELECT magnification, fine_cluster_id, 'primary_site' AS field, primary_site AS value FROM tiles UNION ALL SELECT magnification, fine_cluster_id, 'tcga_project', tcga_project FROM tiles UNION ALL SELECT magnification, fine_cluster_id, 'patient_id', CAST(patient_id AS VARCHAR) FROM tiles UNION ALL SELECT magnification, fine_cluster_id, 'slide_id', CAST(slide_id AS VARCHAR) FROM tiles),
c AS (SELECT magnification, bucket, field, value, count(*) AS n FROM v JOIN m USING (magnification, fine_cluster_id) GROUP BY ALL)
SELECT magnification, bucket, field, CAST(sum(n) AS BIGINT) AS n_tiles, arg_min(value, (-n, value)) AS dominant, round(max(n) / sum(n), 6) AS dominant_fraction FROM c GROUP BY ALL""",
)
def a18_dominance(spark, d):
    return buckets.dominance(_assigned(spark, d), P.tiles(spark, d), ["primary_site", "tcga_project", "patient_id", "slide_id"]).withColumn("dominant_fraction", F.round("dominant_fraction", 6))


@query("a22_diagnostics", f"{COMP} SELECT magnification, round(avg(CAST(is_artifact_excluded AS INT)), 6) AS artifact_share, {', '.join(f'count(*) FILTER (is_{b}) AS n_{b}' for b in buckets.SCORES)}, count(*) FILTER (sampling_eligible) AS n_eligible FROM bucketed GROUP BY magnification")
def a22_diagnostics(spark, d):
    return _assigned(spark, d).groupBy("magnification").agg(F.round(F.avg(F.col("is_artifact_excluded").cast("int")), 6).alias("artifact_share"), *[F.count_if(f"is_{b}").alias(f"n_{b}") for b in buckets.SCORES], F.count_if("sampling_eligible").alias("n_eligible"))


@query("d17_coarse_to_fine", f"{COMP} SELECT magnification, coarse_cluster_id, string_agg(CAST(fine_cluster_id AS VARCHAR), ',' ORDER BY fine_cluster_id) AS fine_ids, coalesce(string_agg(CAST(fine_cluster_id AS VARCHAR), ',' ORDER BY fine_cluster_id) FILTER (is_rare_clean), '') AS rare_clean_ids FROM (SELECT *, fine_cluster_id % 5 AS coarse_cluster_id FROM bucketed) GROUP BY ALL")
def d17_coarse_to_fine(spark, d):
    doc = buckets.hierarchy_document(_assigned(spark, d).withColumn(COARSE, F.col(FINE) % 5))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return doc.select("magnification", COARSE, join("fine_cluster_ids").alias("fine_ids"), join("rare_clean").alias("rare_clean_ids"))


@query("u06_mapping_check", f"{TILES}, p AS (SELECT DISTINCT magnification, fine_cluster_id, coarse_cluster_id FROM tiles) SELECT count(*) AS n_pairs, count(DISTINCT (magnification, fine_cluster_id)) AS n_fine, count(*) - count(DISTINCT (magnification, fine_cluster_id)) AS repeated FROM p")
def u06_mapping_check(spark, d):
    by = P.tiles(spark, d).select("magnification", FINE, COARSE).distinct().groupBy("magnification", FINE).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_fine"), (F.sum("n") - F.count(F.lit(1))).alias("repeated"))


@query("j01_unmatched", f"{TILES}, s AS (SELECT DISTINCT fine_cluster_id FROM tiles), e AS (SELECT DISTINCT label AS fine_cluster_id FROM embeddings) SELECT count(*) FILTER (e.fine_cluster_id IS NULL) AS left_only, count(*) FILTER (s.fine_cluster_id IS NULL) AS right_only, CAST(0 AS BIGINT) AS repeated FROM s FULL JOIN e ON s.fine_cluster_id = e.fine_cluster_id")
def j01_unmatched(spark, d):
    return buckets.unmatched(P.tiles(spark, d).select(FINE).distinct(), P.vectors(spark, d).select(FINE).distinct(), [FINE])


@query("q05_review", f"{COMP}, k AS (SELECT DISTINCT magnification || 'x:' || fine_cluster_id AS cluster_key, fine_cluster_id, magnification FROM bucketed), r AS (SELECT * FROM k WHERE fine_cluster_id % 6 <> 0 UNION ALL SELECT * FROM k WHERE fine_cluster_id = 3) SELECT count(n) AS reviewed, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (cluster_key LIKE '5x%' AND n IS NOT NULL) AS wrongly_bound, count(*) FILTER (f % 4 = 1 AND n IS NOT NULL) AS rejected FROM (SELECT k.cluster_key, k.fine_cluster_id AS f, (SELECT nullif(count(*), 0) FROM r WHERE r.cluster_key = k.cluster_key) AS n FROM k)")
def q05_review(spark, d):
    keys = _assigned(spark, d).select(X.cluster_key(F.col("magnification"), F.col(FINE)).alias("cluster_key"), FINE, "magnification")
    review = keys.where("fine_cluster_id % 6 <> 0").unionByName(keys.where("fine_cluster_id = 3"))
    review = review.withColumns({"decision": F.when(F.col(FINE) % 4 == 1, "reject").otherwise(" Approve"), "reviewer": F.lit("r1"), "run_config_hash": F.when(F.col("magnification") == 5, "old").otherwise("now")})
    return checks.validated_review(review, keys, {"run_config_hash": "now"})


# --- compiled index and sampling --------------------------------------------


@query("w04_csr_offsets", f"{TILES}, g AS (SELECT magnification, coarse_cluster_id, fine_cluster_id, slide_id, count(*) AS n_entries FROM tiles GROUP BY ALL) SELECT *, CAST(sum(n_entries) OVER o - n_entries AS BIGINT) AS entry_start, CAST(sum(n_entries) OVER o AS BIGINT) AS entry_end FROM g WINDOW o AS (ORDER BY magnification, coarse_cluster_id, fine_cluster_id, slide_id)")
def w04_csr_offsets(spark, d):
    return index.slide_groups(P.tiles(spark, d))


@query("w07_slide_ids", "SELECT o_orderkey AS slide_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS slide_index FROM (SELECT DISTINCT o_orderkey FROM orders)")
def w07_slide_ids(spark, d):
    return index.slide_ids(P.table(spark, d, "orders").select(F.col("o_orderkey").alias("slide_id")), "slide_id")


@query("c20_fine_records", f"{TILES}, c AS (SELECT magnification, coarse_cluster_id, fine_cluster_id, count(DISTINCT slide_id) AS n_slides, count(*) AS n_entries FROM tiles GROUP BY ALL) SELECT *, CAST(sum(n_slides) OVER o - n_slides AS BIGINT) AS slide_start, CAST(sum(n_slides) OVER o AS BIGINT) AS slide_end, 1 AS bucket_mask FROM c WINDOW o AS (ORDER BY magnification, coarse_cluster_id, fine_cluster_id)")
def c20_fine_records(spark, d):
    return index.fine_records(P.tiles(spark, d))


@query(
    "q10_index_violations",
    f"""{TILES}, c AS (SELECT magnification, coarse_cluster_id, fine_cluster_id FROM tiles GROUP BY ALL),
g AS (SELECT magnification, coarse_cluster_id, fine_cluster_id, slide_id, count(*) AS n FROM tiles GROUP BY ALL), o AS (SELECT *, sum(n) OVER (ORDER BY magnification, coarse_cluster_id, fine_cluster_id, slide_id) AS entry_end FROM g)
SELECT (SELECT count(*) + count(*) FILTER (coarse_cluster_id = 1) FROM c WHERE fine_cluster_id % 7 = 0) AS empty_cells, (SELECT count(*) + count(*) FILTER (coarse_cluster_id = 1) FROM c WHERE fine_cluster_id % 4 = 0) AS not_random, (SELECT count(*) FROM c WHERE coarse_cluster_id = 1) AS repeated_cells,
  count(*) FILTER (slide_id % 11 = 0) AS empty_groups, CAST(sum(n) - max(CASE WHEN slide_id % 11 = 0 THEN entry_end - n ELSE entry_end END) AS BIGINT) AS uncovered_entries FROM o WHERE slide_id % 13 <> 0""",
)
def q10_index_violations(spark, d):
    """An index with planted faults: cells without slides, without the random bit and twice, groups without entries and left out."""
    t = P.tiles(spark, d)
    records, entries = index.fine_records(t), index.slide_groups(t)
    records = records.withColumn("slide_end", F.when(F.col(FINE) % 7 == 0, F.col("slide_start")).otherwise(F.col("slide_end"))).withColumn("bucket_mask", F.when(F.col(FINE) % 4 == 0, 0).otherwise(F.col("bucket_mask")))
    entries = entries.withColumn("entry_end", F.when(F.col("slide_id") % 11 == 0, F.col("entry_start")).otherwise(F.col("entry_end")))
    return index.violations(records.unionByName(records.where(F.col(COARSE) == 1)), entries.where("slide_id % 13 <> 0"))


MIX = {5: 0.1, 10: 0.2, 20: 0.3, 40: 0.4}


def _draws(spark, d, n=2000):
    t = P.packed_rows(P.tiles(spark, d))
    return index.draws(spark, t, index.fine_records(t), n, MIX, {"random": 1.0})


@query("r04_weighted_magnifications", f"WITH d AS (SELECT i AS draw FROM range(4000) t(i)), {P.random_sql('r', 'd', 7, 0, 'r0')} SELECT {P.choice_sql('r0', MIX)} AS magnification, count(*) AS n FROM r GROUP BY ALL")
def r04_weighted_magnifications(spark, d):
    from lamina.functions import rng

    return spark.range(4000).select(rng.choice(rng.random_unit(7, F.col("id"), 0), MIX).alias("magnification")).groupBy("magnification").agg(F.count(F.lit(1)).alias("n"))


@query("r03_draws", f"WITH {P.draws_sql(2000, MIX)} SELECT * FROM drawn")
def r03_draws(spark, d):
    return _draws(spark, d)


@query("r03_draw_distribution", f"WITH {P.draws_sql(20000, MIX)} SELECT magnification, coarse_cluster_id, count(*) AS n FROM drawn GROUP BY ALL")
def r03_draw_distribution(spark, d):
    return _draws(spark, d, 20000).groupBy("magnification", COARSE).agg(F.count(F.lit(1)).alias("n"))


@query("r05_strided", "SELECT event_id FROM events WHERE event_id % 8 = 3")
def r05_strided(spark, d):
    return index.strided(P.table(spark, d, "events").select("event_id"), "event_id", 3, 8)


@query("r06_per_class_sample", "SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('3:' || vec_id), vec_id) AS r FROM embeddings) WHERE r <= 5")
def r06_per_class_sample(spark, d):
    return index.sample_per_group(P.table(spark, d, "embeddings"), "label", "vec_id", 5, 3).select("vec_id", "label")


@query("r07_split", "SELECT CAST('0x' || substr(md5('0:' || vec_id), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE < 0.9::DOUBLE AS is_train, count(*) AS n FROM embeddings GROUP BY ALL")
def r07_split(spark, d):
    return index.split(P.table(spark, d, "embeddings"), "vec_id").groupBy("is_train").agg(F.count(F.lit(1)).alias("n"))


@query("r02_per_slide_cap", "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT CAST(sum(least(n, 3)) AS BIGINT) AS selected, count(*) AS slides FROM n")
def r02_per_slide_cap(spark, d):
    rows = P.packed_rows(P.tiles(spark, d)).select("slide_id", "packed_row_index")
    kept = index.sample_per_group(rows, "slide_id", "packed_row_index", 3)
    return kept.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("selected"), F.count(F.lit(1)).alias("slides"))


# --- evaluation --------------------------------------------------------------

KNN = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query, t.vec_id AS neighbour, round(list_dot_product(q.v, t.v), 9) AS similarity FROM e q JOIN e t ON q.vec_id % 10 = 0 AND t.vec_id % 10 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM s), nn AS (SELECT * FROM k WHERE rank <= 20)"""
VOTES = """, w AS (SELECT *, exp((similarity - max(similarity) OVER (PARTITION BY query)) / 0.07::DOUBLE) AS x FROM nn), p AS (SELECT *, x / sum(x) OVER (PARTITION BY query) AS y FROM w),
v AS (SELECT query, kk AS k, label, sum(y) AS weight FROM p JOIN embeddings ON neighbour = vec_id, (VALUES (10), (20)) ks(kk) WHERE rank <= kk GROUP BY ALL)"""


def _neighbours(spark, d):
    e = P.table(spark, d, "embeddings")
    return neighbours.top_k(e.where("vec_id % 10 = 0"), e.where("vec_id % 10 <> 0"), 20)


@query("j15_knn_topk", f"WITH {KNN} SELECT query, neighbour, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM nn")
def j15_knn_topk(spark, d):
    return _neighbours(spark, d).withColumn("similarity", F.round("similarity", 6))


@query("a25_knn_vote", f"WITH {KNN}{VOTES} SELECT query, k, label, round(weight, 6) AS weight FROM v")
def a25_knn_vote(spark, d):
    return neighbours.votes(_neighbours(spark, d), P.table(spark, d, "embeddings"), [10, 20]).withColumn("weight", F.round("weight", 6))


@query("a26_topk_accuracy", f"WITH {KNN}{VOTES}, o AS (SELECT *, row_number() OVER (PARTITION BY query, k ORDER BY round(weight, 9) DESC, label) AS place FROM v), h AS (SELECT o.query, k, top, e.label, max(CAST(o.label = e.label AND place <= top AS INT)) AS hit FROM o JOIN embeddings e ON o.query = e.vec_id, (VALUES (1), (5)) t(top) GROUP BY ALL), c AS (SELECT k, top, label, sum(hit) AS h, count(*) AS n FROM h GROUP BY ALL) SELECT k, top, round(sum(h) / sum(n), 6) AS micro, round(avg(h / n), 6) AS macro FROM c GROUP BY ALL")
def a26_topk_accuracy(spark, d):
    e = P.table(spark, d, "embeddings")
    predicted = neighbours.predictions(neighbours.votes(_neighbours(spark, d), e, [10, 20]))
    return neighbours.accuracies(neighbours.hits(predicted, e, [1, 5])).select("k", "top", F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


@query("a28_best_k", f"WITH {KNN}{VOTES}, o AS (SELECT *, row_number() OVER (PARTITION BY query, k ORDER BY round(weight, 9) DESC, label) AS place FROM v), a AS (SELECT k, round(avg(CAST(o.label = e.label AS INT)), 6) AS accuracy FROM o JOIN embeddings e ON o.query = e.vec_id WHERE place = 1 GROUP BY k) SELECT k, accuracy FROM a ORDER BY accuracy DESC, k LIMIT 1")
def a28_best_k(spark, d):
    e = P.table(spark, d, "embeddings")
    predicted = neighbours.predictions(neighbours.votes(_neighbours(spark, d), e, [10, 20]))
    got = neighbours.accuracies(neighbours.hits(predicted, e, [1])).select("k", F.round("micro", 6).alias("accuracy"))
    return neighbours.best_by(got, "accuracy", "k", ["k"])


@query("j16_nearest_neighbour", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT q.vec_id AS query, t.vec_id AS neighbour, round(list_dot_product(q.v, t.v), 9) AS similarity FROM e q JOIN e t ON q.vec_id % 20 = 0 AND q.vec_id <> t.vec_id) SELECT query, neighbour, round(similarity, 6) AS similarity, 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS r FROM s) WHERE r = 1")
def j16_nearest_neighbour(spark, d):
    e = P.table(spark, d, "embeddings")
    return neighbours.top_k(e.where("vec_id % 20 = 0"), e, 1, skip_self=True).withColumn("similarity", F.round("similarity", 6))


@query("m03_assign", f"{SEM}, e AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), x AS (SELECT vec_id, cent.fine_cluster_id AS cluster, round(sum((e.v - cent.v) * (e.v - cent.v)), 9) AS distance FROM e JOIN cent USING (dim) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) AS r FROM x) SELECT vec_id, CAST(cluster AS BIGINT) AS cluster, round(distance, 6) AS distance FROM r WHERE r = 1")
def m03_assign(spark, d):
    import numpy as np

    e = P.vectors(spark, d)
    centers = semantic.directions(semantic.sums(e, [FINE]), [FINE]).orderBy(FINE).select("centroid").collect()  # k vectors
    return kmeans.assign(e, np.array([c[0] for c in centers]), "vec_id").withColumn("distance", F.round("distance", 6))


@query("m02_kmeans")
def m02_kmeans(spark, d):
    e = P.table(spark, d, "embeddings")
    centers, _ = kmeans.fit(e, 10)
    return kmeans.assign(e, centers, "vec_id").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 6).alias("cost"))


@query("m05_hierarchy")
def m05_hierarchy(spark, d):
    e = P.table(spark, d, "embeddings")
    centers, _ = kmeans.fit(e, 12)
    levels = kmeans.hierarchy(centers, [4])
    parents = spark.createDataFrame([(i, int(p)) for i, p in enumerate(levels[0][1])], "cluster long, coarse long")
    return kmeans.assign(e, centers, "vec_id").join(F.broadcast(parents), "cluster").groupBy("coarse", "cluster").agg(F.count(F.lit(1)).alias("n"))


@query("m06_regression_sweep")
def m06_regression_sweep(spark, d):
    from lamina.operators import regression

    e = P.table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("label"))
    return regression.sweep(index.split(e, "vec_id"), regression.STRENGTHS)


# --- ordered -----------------------------------------------------------------


@query("a29_islands", "WITH m AS (SELECT event_type, user_id % 10 AS g, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS i FROM events), b AS (SELECT *, i - row_number() OVER (PARTITION BY g ORDER BY i) AS run FROM m WHERE event_type = 'error'), r AS (SELECT g, run, min(i) AS first, count(*) AS length FROM b GROUP BY g, run) SELECT g, CAST(sum(length) AS BIGINT) AS n_bad, count(*) AS n_runs, max(length) AS longest, arg_min(first, (-length, first)) AS longest_first FROM r GROUP BY g")
def a29_islands(spark, d):
    e = P.table(spark, d, "events").withColumn("g", F.col("user_id") % 10)
    return series.run_summary(series.islands(e, "g", ["ts", "event_id"], F.col("event_type") == "error"), "g").withColumn("longest_first", F.col("longest_first").cast("long"))


@query("w06_trailing_meter", "SELECT event_id, round(list_sort(list(value) OVER w)[CAST(floor((count(*) OVER w + 1) / 2) AS INT)], 6) AS median, round(avg(value) OVER w, 6) AS mean, round(max(value) OVER w, 6) AS maximum, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS global_mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def w06_trailing_meter(spark, d):
    out = series.trailing(P.table(spark, d, "events"), "event_type", ["ts", "event_id"], "value")
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in ("median", "mean", "maximum")], F.round(F.col("global_mean") + 1e-9, 6).alias("global_mean"))


@query("w09_retention", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def w09_retention(spark, d):
    return series.retained(P.table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey")


@query("w05_changes", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def w05_changes(spark, d):
    return series.changes(P.table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "event_type")


@query("w08_first_offender", "SELECT event_type, arg_min(event_id, (ts, event_id)) AS first_bad FROM events WHERE value > 150 GROUP BY event_type")
def w08_first_offender(spark, d):
    return P.table(spark, d, "events").where("value > 150").groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_bad"))


@query("p29_schedule", "SELECT i, CASE WHEN i >= 100 THEN 0.1::DOUBLE WHEN i < 5 THEN 0.0 WHEN i < 15 THEN round(0.0 + 1.0 * (i - 5) / 9, 6) ELSE round(0.1::DOUBLE + 0.45::DOUBLE * (1 + cos(pi() * (i - 15) / 85)), 6) END AS lr FROM range(120) t(i)")
def p29_schedule(spark, d):
    return spark.range(120).select(F.col("id").alias("i"), F.round(schedules.cosine(F.col("id"), 1.0, 0.1, 100, warmup=10, freeze=5), 6).alias("lr"))


@query("x15_log_every", "SELECT event_id FROM events WHERE event_id % 250 = 0 OR event_id = (SELECT max(event_id) FROM events)")
def x15_log_every(spark, d):
    e = P.table(spark, d, "events").select("event_id")
    return series.every(e.crossJoin(F.broadcast(e.agg(F.max("event_id").alias("m")))), "event_id", 250, F.col("m")).select("event_id")


# --- text, sets, documents ----------------------------------------------------


@query("p06_concept_id", r"SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name || ' / ' || p_type || '-X!')), '[^\p{L}\p{N} \-/_]', '', 'g'), '[ \-/_]+', '_', 'g'), '_') AS concept_id FROM part")
def p06_concept_id(spark, d):
    return P.table(spark, d, "part").select("p_partkey", X.concept_id(F.concat("p_name", F.lit(" / "), "p_type", F.lit("-X!"))).alias("concept_id"))


TEMPLATES = ["a tile of CLASSNAME", "{} tissue", "this shows"]


@query("p07_templates", "WITH c AS (SELECT DISTINCT p_type FROM part), t AS (SELECT p_type, i, CASE i WHEN 0 THEN 'a tile of ' || p_type WHEN 1 THEN p_type || ' tissue' ELSE 'this shows ' || p_type END AS prompt FROM c, range(3) x(i)) SELECT p_type AS concept, CAST(i AS INT) AS template_id, prompt FROM t")
def p07_templates(spark, d):
    c = P.table(spark, d, "part").select(F.col("p_type").alias("concept")).distinct().withColumns({"polarity": F.lit("positive"), "category": F.lit("architecture")})
    return X.prompts(c, TEMPLATES).select("concept", "template_id", "prompt")


@query("u05_dedup", "SELECT min(doc_id) AS doc_id, length(text) AS n_chars FROM documents GROUP BY text")
def u05_dedup(spark, d):
    docs = P.table(spark, d, "documents")
    return docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query("p27_redaction")
def p27_redaction(spark, d):
    return X.redacted(P.table(spark, d, "documents"))


@query("p28_placeholders", "SELECT p_partkey, replace(replace('{{NAME}} by {{BRAND}}', '{{NAME}}', p_name), '{{BRAND}}', 'b') AS text, CAST(0 AS INT) AS n_left FROM part")
def p28_placeholders(spark, d):
    text = F.replace(X.configured(F.lit("{{NAME}} by {{BRAND}}"), {"BRAND": "b"}), F.lit("{{NAME}}"), F.col("p_name"))
    return P.table(spark, d, "part").select("p_partkey", text.alias("text")).withColumn("n_left", X.placeholders_left(F.col("text")))


@query("p02_path_names", r"SELECT o_orderkey, 'S-' || o_orderkey AS slide, 'S-' || o_orderkey || '.a' AS stem, 'S-' || o_orderkey AS bare FROM orders")
def p02_path_names(spark, d):
    s = F.concat(F.lit("S-"), F.col("o_orderkey").cast("string"))
    path = F.concat(F.lit("/x/y/"), s, F.lit(".a.svs"))
    return P.table(spark, d, "orders").select("o_orderkey", X.slide_of_file(path).alias("slide"), X.stem(path).alias("stem"), X.without_patch_suffix(F.concat(s, F.lit("_patches"))).alias("bare"))


@query("p13_level0_size", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(CASE WHEN l_quantity > 40 THEN l_quantity ELSE round_even(CAST(l_partkey % 1000 AS DOUBLE) * 5 / 10, 0) END AS INT) AS size FROM lineitem")
def p13_level0_size(spark, d):
    explicit = F.when(F.col("l_quantity") > 40, F.col("l_quantity"))
    return P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", X.patch_size_level0(explicit, F.col("l_partkey") % 1000, F.lit(5), F.lit(10)).alias("size"))


@query("p22_fingerprint", "SELECT n_nationkey, sha256(n_nationkey || '|' || n_name || '|' || n_regionkey) AS fingerprint FROM nation")
def p22_fingerprint(spark, d):
    return P.table(spark, d, "nation").select("n_nationkey", D.row_fingerprint([F.col(c) for c in ("n_nationkey", "n_name", "n_regionkey")]).alias("fingerprint"))


@query("s14_prompt_sources", r"SELECT 'benchmark_' || item_id AS prompt_id, trim(text) AS prompt FROM benchmark WHERE trim(text) <> '' UNION ALL SELECT conv_id || '_' || turn, trim(text) FROM conversations WHERE trim(text) <> '' AND role = 'user'")
def s14_prompt_sources(spark, d):
    b = P.table(spark, d, "benchmark").select(F.concat(F.lit("benchmark_"), F.col("item_id").cast("string")).alias("prompt_id"), F.col("text").alias("prompt"))
    c = P.table(spark, d, "conversations").where("role = 'user'").select(F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("prompt_id"), F.col("text").alias("prompt"))
    return files.named_prompts(b.unionByName(c))


@query("s09_double_keys", "SELECT DISTINCT k AS slide_id, c_custkey AS record FROM (SELECT c_custkey, unnest([c_name, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'f' || c_custkey END]) AS k FROM customer)")
def s09_double_keys(spark, d):
    rows = P.table(spark, d, "customer").select(F.col("c_custkey").alias("record"), F.col("c_name").alias("slide_submitter_id"), F.concat(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("f"), F.col("c_custkey").cast("string"))), F.lit(".x.svs")).alias("file_name"))
    return files.slide_metadata(rows).select("slide_id", "record")


@query("s07_row_starts", "WITH s AS (SELECT [5, 10, 20, 40][l_linenumber % 4 + 1] AS mag, l_orderkey % 50 AS path, count(*) AS n_tiles FROM lineitem GROUP BY ALL) SELECT mag, path, n_tiles, CAST(sum(n_tiles) OVER (PARTITION BY mag ORDER BY path) - n_tiles AS BIGINT) AS row_start FROM s")
def s07_row_starts(spark, d):
    s = P.table(spark, d, "lineitem").groupBy(P.magnification().alias("mag"), (F.col("l_orderkey") % 50).alias("path")).agg(F.count(F.lit(1)).alias("n_tiles"))
    return files.with_row_start(s)


@query("p23_wsi_paths", "SELECT o_orderkey AS slide_id, CASE WHEN o_orderkey % 5 = 0 THEN '/m/' || o_orderkey ELSE '/t/' || o_orderkey || '/' || o_orderstatus || '.svs' END AS wsi_path FROM orders")
def p23_wsi_paths(spark, d):
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("slide_id"), F.col("o_orderstatus").alias("status"))
    manifest = o.where("slide_id % 5 = 0").select(F.col("slide_id").alias("wsi_key"), F.concat(F.lit("/m/"), F.col("slide_id").cast("string")).alias("wsi_path"))
    return files.resolved_wsi(o, manifest, "/t/{slide_id}/{status}.svs", ("slide_id",)).select("slide_id", "wsi_path")


@query("u02_inventory", "SELECT place, count(*) AS n FROM (SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS place FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 30) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 12) b ON a.k = b.k) GROUP BY place")
def u02_inventory(spark, d):
    line = P.table(spark, d, "lineitem")
    return checks.inventory(line.where("l_quantity > 30"), line.where("l_quantity < 12"), "l_partkey").groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query("u01_union", "SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0 UNION SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0")
def u01_union(spark, d):
    e = P.table(spark, d, "embeddings").select("vec_id")
    return e.where("vec_id % 3 = 0").unionByName(e.where("vec_id % 5 = 0")).distinct()


RGB = "(l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 31) % 16777216"


@query("p14_hsv", f"WITH p AS (SELECT l_orderkey % 64 AS image, CAST({RGB} AS INT) AS rgb FROM lineitem), c AS (SELECT image, (rgb >> 16) & 255 AS r, (rgb >> 8) & 255 AS g, rgb & 255 AS b FROM p), m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM c), s AS (SELECT *, (d * CASE WHEN v = 0 THEN 0 ELSE CAST(round_even(1044480.0::DOUBLE / v, 0) AS INT) END + 2048) >> 12 AS s, CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END AS e FROM m), h AS (SELECT *, CAST(floor((e * CASE WHEN d = 0 THEN 0 ELSE CAST(round_even(737280.0::DOUBLE / (6.0::DOUBLE * d), 0) AS INT) END + 2048) / 4096) AS INT) AS h0 FROM s) SELECT image, count(*) AS n, round(avg(CAST((CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END) BETWEEN 90 AND 180 AND s BETWEEN 8 AND 255 AND v BETWEEN 103 AND 255 AS INT)), 6) AS coverage FROM h GROUP BY image")
def p14_hsv(spark, d):
    rgb = ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey") * 31) % 16777216).cast("int")
    p = P.table(spark, d, "lineitem").select((F.col("l_orderkey") % 64).alias("image"), rgb.alias("rgb"))
    return p.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(images.in_range(F.col("rgb")).cast("int")), 6).alias("coverage"))


@query("p16_integral", "WITH c AS (SELECT l_suppkey % 4 AS image, l_orderkey % 12 AS y, l_partkey % 12 AS x, count(*) AS n FROM lineitem GROUP BY ALL) SELECT image, y, x, n, CAST((SELECT sum(n) FROM c o WHERE o.image = c.image AND o.y <= c.y AND o.x <= c.x) AS BIGINT) AS integral FROM c")
def p16_integral(spark, d):
    c = P.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("image"), (F.col("l_orderkey") % 12).alias("y"), (F.col("l_partkey") % 12).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return images.integral(c, "image", "y", "x", "n")


@query("f11_batch_checks", f"{TILES} SELECT count(*) AS n, count(*) FILTER (magnification NOT IN (5, 10, 20, 40)) AS bad_magnification, count(*) FILTER (x < 0 OR x > 2147483647) AS bad_x, count(*) FILTER (slide_id IS NULL) AS no_slide FROM tiles")
def f11_batch_checks(spark, d):
    return P.tiles(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("magnification").isin(5, 10, 20, 40)).alias("bad_magnification"), F.count_if((F.col("x") < 0) | (F.col("x") > 2147483647)).alias("bad_x"), F.count_if(F.col("slide_id").isNull()).alias("no_slide"))


BROKEN = {
    "tile_count": "SELECT CAST(count(*) <> count(*) FILTER (quantity < 40) AS BIGINT) AS v FROM tiles",
    "cluster_keys_unique": "SELECT count(*) AS v FROM bucketed WHERE fine_cluster_id % 6 = 0",
    "coarse_to_fine_exhaustive": "SELECT count(DISTINCT (magnification, fine_cluster_id)) AS v FROM tiles WHERE fine_cluster_id % 4 = 0",
    "scores_bounded": "SELECT count(*) AS v FROM scored WHERE NOT (3 * raw_cosine BETWEEN -1.0001 AND 1.0001)",
    "composite_formula": "SELECT count(*) AS v FROM bucketed WHERE fine_cluster_id % 3 = 0",
    "excluded_not_prioritized": "SELECT count(*) AS v FROM bucketed WHERE fine_cluster_id % 2 = 0 AND (is_bridge OR is_architecture_bridge OR is_architecture_specific OR is_rare_clean OR is_tissue_specific)",
    "random_matches_eligibility": "SELECT count(*) AS v FROM bucketed WHERE fine_cluster_id % 5 = 0",
}
#: The same rules on the tables as they are.
SOUND = {
    "tile_count": "SELECT CAST((SELECT count(*) FROM tiles) <> (SELECT count(*) FROM lineitem) AS BIGINT) AS v",
    "cluster_keys_unique": "SELECT count(*) - count(DISTINCT (magnification, fine_cluster_id)) AS v FROM bucketed",
    "coarse_to_fine_exhaustive": "SELECT count(*) AS v FROM (SELECT 1 FROM tiles GROUP BY magnification, fine_cluster_id HAVING count(DISTINCT coarse_cluster_id) > 1)",
    "scores_bounded": "SELECT count(*) AS v FROM scored WHERE NOT (raw_cosine BETWEEN -1.0001 AND 1.0001 AND percentile_score BETWEEN 0 AND 1)",
    "composite_formula": "SELECT count(*) AS v FROM bucketed WHERE abs(clean_score - useful_score * cleanliness) > 1e-6",
    "excluded_not_prioritized": "SELECT count(*) AS v FROM bucketed WHERE NOT sampling_eligible AND (is_bridge OR is_architecture_bridge OR is_architecture_specific OR is_rare_clean OR is_tissue_specific)",
    "random_matches_eligibility": "SELECT count(*) FILTER (sampling_eligible <> NOT (is_artifact_excluded OR is_support_excluded)) AS v FROM bucketed",
}
_rules = lambda rules, mark: " UNION ALL ".join(f"SELECT '{n}{mark}' AS name, v = 0 AS passed, v AS violations FROM ({q})" for n, q in rules.items())


@query("q04_invariants", f"{COMP} {_rules(SOUND, '')} UNION ALL {_rules(BROKEN, '_broken')}")
def q04_invariants(spark, d):
    """The rules on the tables as they are, and on tables with planted faults, whose number SQL counts."""
    t, c, scored = P.tiles(spark, d), _assigned(spark, d), _scored(spark, d)
    fine = ["magnification", FINE]
    k = F.col("cleanliness")
    off = F.abs(F.col("clean_score") - F.col("useful_score") * k) > 1e-6
    off |= F.abs(F.col("rare_clean_score") - F.col("rarity_score") * F.col("useful_score") * k * F.col("patient_support") * k) > 1e-6
    any_bucket = F.greatest(*[F.col(f"is_{b}").cast("int") for b in buckets.SCORES]) == 1

    def rules(mark, tiles, pairs, unique, scored, formula, excluded, random):
        counted = clusters.tile_counts(tiles, FINE).agg(F.sum("n_tiles").alias("a")).crossJoin(P.table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("b")))
        return [
            checks.check(f"tile_count{mark}", counted, checks.count_where(F.col("a") != F.col("b"))),
            checks.unique(f"cluster_keys_unique{mark}", unique, fine),
            checks.unique(f"coarse_to_fine_exhaustive{mark}", pairs, fine),
            checks.check(f"scores_bounded{mark}", scored, checks.count_where((F.col("raw_cosine").between(-1.0001, 1.0001) & F.col("percentile_score").between(0, 1)) == F.lit(False))),
            checks.check(f"composite_formula{mark}", formula, checks.count_where(off)),
            checks.check(f"excluded_not_prioritized{mark}", excluded, checks.count_where(~F.col("sampling_eligible") & any_bucket)),
            checks.check(f"random_matches_eligibility{mark}", random, checks.count_where(F.col("is_random_eligible") != F.col("sampling_eligible"))),
        ]

    pairs = t.select(*fine, COARSE).distinct()
    where = lambda n: F.col(FINE) % n == 0
    broken = rules(
        "_broken",
        t.where("quantity < 40"),
        pairs.unionByName(pairs.where(where(4)).withColumn(COARSE, F.col(COARSE) + 1)),
        c.select(*fine).unionByName(c.where(where(6)).select(*fine)),
        scored.withColumn("raw_cosine", F.col("raw_cosine") * 3),
        c.withColumn("clean_score", F.when(where(3), F.col("clean_score") + 0.1).otherwise(F.col("clean_score"))),
        c.withColumn("sampling_eligible", F.col("sampling_eligible") & ~where(2)),
        c.withColumn("is_random_eligible", F.col("is_random_eligible") != where(5)),
    )
    return checks.all_of([*rules("", t, pairs, c, scored, c, c, c), *broken])


# --- streams -------------------------------------------------------------------


@query("st_windowed_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st_windowed_counts(spark, d):
    """The batch run of the windowed stream; tests run the same plan as a stream."""
    w = F.window("ts", "1 day")
    return P.table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("st_draw_stream", f"WITH d AS (SELECT i AS draw FROM range(2000) t(i)), {P.random_sql('r', 'd', 7, 3, 'r0')} SELECT {P.index_sql('r0', '37')} AS entry, count(*) AS n FROM r GROUP BY ALL")
def st_draw_stream(spark, d):
    """2,000 draws from the stream source, drained through a checkpointed query."""
    import uuid

    from lamina.streaming import streams

    return streams.drained(streams.draws(spark, 37, seed=7, stream=3, total=2000), f"draws_{uuid.uuid4().hex}").groupBy("entry").agg(F.count(F.lit(1)).alias("n"))


# --- relations between artifacts -------------------------------------------------


@query("j04_assignment_join", f"{TILES}, {P.PACKED} SELECT magnification, coarse_cluster_id, count(*) AS n, CAST(sum(packed_row_index) AS BIGINT) AS rows_sum FROM packed GROUP BY ALL")
def j04_assignment_join(spark, d):
    t = P.packed_rows(P.tiles(spark, d))
    hierarchy = t.select("magnification", FINE, COARSE).distinct()
    out = relations.with_assignment(t.select("magnification", "packed_row_index", "slide_id"), t.select("magnification", "packed_row_index", FINE), hierarchy)
    return out.groupBy("magnification", COARSE).agg(F.count(F.lit(1)).alias("n"), F.sum("packed_row_index").alias("rows_sum"))


@query("j07_unknown_clusters", f"{TILES} SELECT magnification, fine_cluster_id, coarse_cluster_id, count(*) AS n_tiles FROM tiles WHERE fine_cluster_id % 7 = 0 OR fine_cluster_id = 11 GROUP BY ALL")
def j07_unknown_clusters(spark, d):
    t = P.tiles(spark, d)
    known = t.select("magnification", FINE, COARSE).distinct().where("fine_cluster_id % 7 <> 0").withColumn(COARSE, F.when(F.col(FINE) == 11, 99).otherwise(F.col(COARSE)))
    return relations.unknown_clusters(t, known)


@query("j08_coordinate_differences", f"WITH l AS (SELECT l_orderkey % 50 AS slide_id, l_orderkey * 8 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(P.KEYS[1:])}) AS r, l_quantity FROM lineitem) SELECT slide_id, count(*) AS rows, count(*) FILTER (l_quantity < 3) AS differing, count(*) FILTER (l_quantity > 49) AS raw_only, CAST(0 AS BIGINT) AS projected_only FROM l GROUP BY slide_id")
def j08_coordinate_differences(spark, d):
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*P.KEYS[1:]))
    raw = P.table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("slide_id"), (F.col("l_orderkey") * 8 + r).alias("row"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), "l_quantity")
    return relations.coordinate_differences(raw, raw.where("l_quantity <= 49").withColumn("y", F.when(F.col("l_quantity") < 3, -1).otherwise(F.col("y"))))


@query("j13_selected_representatives", f"{COMP}, a AS ({AUDITED}), r AS (SELECT *, row_number() OVER (PARTITION BY magnification, bucket ORDER BY o, fine_cluster_id) AS rank FROM a), c AS (SELECT magnification, fine_cluster_id, string_agg(DISTINCT bucket, ',' ORDER BY bucket) AS buckets FROM r WHERE rank <= 3 GROUP BY ALL), p AS (SELECT magnification, fine_cluster_id, slide_id, row_number() OVER (PARTITION BY magnification, fine_cluster_id ORDER BY x, y, slide_id) AS place FROM tiles) SELECT p.magnification, p.fine_cluster_id, slide_id, CAST(place AS INT) AS place, buckets FROM p JOIN c USING (magnification, fine_cluster_id) WHERE place <= 2")
def j13_selected_representatives(spark, d):
    place = F.row_number().over(Window.partitionBy("magnification", FINE).orderBy("x", "y", "slide_id"))
    first = P.tiles(spark, d).withColumn("place", place).where("place <= 2").select("magnification", FINE, "slide_id", "place")
    out = relations.selected_representatives(buckets.selection(_assigned(spark, d), 3), first)
    return out.select("magnification", FINE, "slide_id", "place", F.array_join("audit_buckets", ",").alias("buckets"))


@query("j17_class_labels", "SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 1) n ON c_nationkey = n_nationkey")
def j17_class_labels(spark, d):
    names = P.table(spark, d, "nation").where("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return relations.class_labels(P.table(spark, d, "customer"), names, "c_nationkey").select("c_custkey", "n_name")


@query("k10_dictionary", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM part")
def k10_dictionary(spark, d):
    return relations.dictionary_encoded(P.table(spark, d, "part"), "p_name", "code").select("p_partkey", "code")


@query("k09_entries", f"{TILES}, {P.PACKED}, s AS (SELECT slide_id, row_number() OVER (ORDER BY slide_id) - 1 AS slide_index FROM (SELECT DISTINCT slide_id FROM tiles)) SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(slide_index AS INT) AS slide_id, magnification AS target_magnification, CAST(10240 / magnification AS INT) AS patch_size_level0 FROM packed JOIN s USING (slide_id)")
def k09_entries(spark, d):
    from lamina.sources import writers

    return writers.entries(P.tiles(spark, d).withColumn("patch_size_level0", (F.lit(10240) / F.col("magnification")).cast("int")))


@query("q08_document_differences", f"{COMP} SELECT magnification, 'random' AS bucket, fine_cluster_id, 'table' AS only FROM bucketed WHERE sampling_eligible AND fine_cluster_id % 9 = 0")
def q08_document_differences(spark, d):
    c = _assigned(spark, d)
    each = c.select("magnification", F.explode("bucket_memberships").alias("bucket"), FINE).where("bucket <> 'random' or fine_cluster_id % 9 <> 0")
    return relations.document_differences(c, each.groupBy("magnification", "bucket").agg(F.collect_list(FINE).alias("fine_cluster_ids")))


@query("q06_evidence", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'ok' END AS state FROM documents")
def q06_evidence(spark, d):
    docs = P.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    rows = docs.select("doc_id", "path", F.when(F.col("doc_id") % 3 == 0, "-").otherwise(F.sha2("content", 256)).alias("sha256"))
    return relations.evidence(rows, docs.where("doc_id % 5 <> 0").select("path", "content")).select("doc_id", "state")


@query(
    "s11_prompt_faults",
    """WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END) AS v FROM embeddings WHERE vec_id < 40),
s AS (SELECT vec_id, CASE WHEN vec_id % 10 = 7 THEN v[1 : len(v) - 1] WHEN vec_id % 10 = 3 THEN list_prepend('NaN'::DOUBLE, v[2:]) ELSE v END AS v FROM c), u AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE vec_id < 5)
SELECT count(*) FILTER (NOT coalesce(abs(sqrt(list_sum(list_transform(v, lambda x: x * x))) - 1) <= 1e-4, false) OR isnan(list_sum(v))) AS not_unit, count(*) FILTER (isnan(list_sum(v))) AS not_finite,
  count(*) FILTER (vec_id % 9 = 0) AS blank, count(*) - count(DISTINCT vec_id) AS repeated, CAST(max(len(v)) - min(len(v)) AS BIGINT) AS size_range FROM u""",
)
def s11_prompt_faults(spark, d):
    """A concept table with planted faults: lengths, a missing dimension, not-a-number, blank categories, repeated rows."""
    i = F.col("concept_id")
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.when(i % 4 == 0, 2).otherwise(1))
    rows = P.concepts(spark, d).withColumn("embedding", scaled)
    cut = F.slice("embedding", 1, F.size("embedding") - 1)
    nan = F.concat(F.array(F.lit(float("nan"))), F.slice("embedding", 2, F.size("embedding") - 1))
    rows = rows.withColumn("embedding", F.when(i % 10 == 7, cut).when(i % 10 == 3, nan).otherwise(F.col("embedding"))).withColumn("category", F.when(i % 9 == 0, " ").otherwise(F.col("category")))
    return relations.prompt_faults(rows.unionByName(rows.where("concept_id < 5")).withColumn("concept_id", i.cast("string")))


@query("s08_exclusions", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'target_above_scan' ELSE NULL END AS reason FROM orders WHERE o_orderkey % 10 <> 0")
def s08_exclusions(spark, d):
    rows = P.table(spark, d, "orders").select("o_orderkey", F.lit(40).alias("target_magnification"), F.when(F.col("o_orderkey") % 4 == 0, 20).otherwise(40).alias("level0_magnification"), (F.col("o_orderkey") % 10).alias("n_tiles"))
    kept, out = files.shards(rows)
    return kept.select("o_orderkey", F.lit(None).cast("string").alias("reason")).unionByName(out.select("o_orderkey", "reason"))


@query("a27_mean_over_tries", "SELECT label, round(avg(s), 6) AS s, count(*) AS tries FROM (SELECT label, vec_id % 5 AS t, sum(vec_id) AS s FROM embeddings GROUP BY ALL) GROUP BY label")
def a27_mean_over_tries(spark, d):
    tries = P.table(spark, d, "embeddings").groupBy("label", (F.col("vec_id") % 5).alias("t")).agg(F.sum("vec_id").alias("s"))
    return relations.mean_over_tries(tries, ["label"], "s").withColumn("s", F.round("s", 6))


@query("a23_centroid_update", f"{SEM}, e AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), x AS (SELECT vec_id, cent.fine_cluster_id AS c, round(sum((e.v - cent.v) * (e.v - cent.v)), 12) AS distance FROM e JOIN cent USING (dim) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, c) AS r FROM x) SELECT CAST(c AS BIGINT) AS cluster, CAST(dim AS BIGINT) AS dim, round(avg(v), 6) + 0.0 AS value FROM r JOIN e USING (vec_id) WHERE r = 1 GROUP BY ALL")
def a23_centroid_update(spark, d):
    import numpy as np

    e = P.vectors(spark, d)
    centers = np.array([r[0] for r in semantic.directions(semantic.sums(e, [FINE]), [FINE]).orderBy(FINE).select("centroid").collect()])  # k vectors
    new, _ = kmeans.updated(e, centers)
    rows = [(c, i, round(float(v), 6) + 0.0) for c, row in enumerate(new) for i, v in enumerate(row)]
    return spark.createDataFrame(rows, "cluster long, dim long, value double")


@query("m09_projection", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) + 0.0 AS total FROM embeddings")
def m09_projection(spark, d):
    import pandas as pd

    return relations.applied(P.table(spark, d, "embeddings").select("vec_id", "embedding"), lambda p: pd.DataFrame({"vec_id": p["vec_id"], "total": [round(float(sum(map(float, v))), 5) + 0.0 for v in p["embedding"]]}), "vec_id long, total double")


@query("r01_floyd", None)
def r01_floyd(spark, d):
    """A sample of fixed size without replacement: the positions are drawn on the driver, bounded by the size, and joined."""
    n = P.table(spark, d, "embeddings").count()
    at = spark.createDataFrame([(int(i),) for i in kmeans.floyd(100, n, 47)], "vec_id long")
    return P.table(spark, d, "embeddings").join(F.broadcast(at), "vec_id").select("vec_id", "label")


@query("u03_union_levels", f"{TILES} SELECT 'fine' AS level, count(DISTINCT (magnification, fine_cluster_id)) AS n FROM tiles UNION ALL SELECT 'coarse', count(DISTINCT (magnification, coarse_cluster_id)) FROM tiles")
def u03_union_levels(spark, d):
    t = P.tiles(spark, d)
    part = lambda name, c: t.select("magnification", c).distinct().agg(F.lit(name).alias("level"), F.count(F.lit(1)).alias("n"))
    return part("fine", FINE).unionByName(part("coarse", COARSE))


@query("x01_repeated_coordinates", "SELECT l_orderkey AS slide_id, CAST(floor(l_extendedprice / 5000) AS BIGINT) AS x, l_linenumber AS y, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def x01_repeated_coordinates(spark, d):
    rows = P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slide_id"), F.floor(F.col("l_extendedprice") / 5000).cast("long").alias("x"), F.col("l_linenumber").alias("y"))
    return rows.groupBy("slide_id", "x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("p12_distances", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT a.vec_id, round(greatest(list_dot_product(a.v, a.v) - 2 * list_dot_product(a.v, b.v) + list_dot_product(b.v, b.v), 0), 6) + 0.0 AS l2, round(2 - 2 * list_cosine_similarity(a.v, b.v), 6) + 0.0 AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def p12_distances(spark, d):
    e = P.table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = e.join(b, "vec_id")
    return both.select("vec_id", (F.round(V.expanded_distance(F.col("embedding"), F.col("other")), 6) + 0.0).alias("l2"), (F.round(V.cosine_distance(F.col("embedding"), F.col("other")), 6) + 0.0).alias("cosine"))


# --- evaluation and provenance ----------------------------------------------------


@query("m08_probe_grid")
def m08_probe_grid(spark, d):
    """Linear probes of two blocks of dimensions and three rates, trained together."""
    rows = index.split(P.table(spark, d, "embeddings"), "vec_id")
    size = len(rows.first()["embedding"])
    out = evaluation.probe_grid(rows.where("is_train"), rows.where("not is_train"), [0.1, 1.0, 10.0], {"all": (0, size), "half": (size // 2, size)}, 10, steps=20)
    return out.select("block", "rate", r6("accuracy"))


@query("a30_reduced", "WITH b AS (SELECT event_id // 100 AS step, event_type AS name, round(avg(value), 6) AS mean, count(value) AS ranks FROM events GROUP BY ALL) SELECT * FROM b")
def a30_reduced(spark, d):
    e = P.table(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("step"), F.col("event_type").alias("name"), "value")
    return evaluation.reduced(e).select("step", "name", r6("mean"), "ranks")


@query("x14_accumulated", "SELECT event_type, CAST(count(*) FILTER (value > 0) AS BIGINT) AS correct, count(*) AS counted, round(count(*) FILTER (value > 0) / count(*), 6) AS value FROM events GROUP BY event_type")
def x14_accumulated(spark, d):
    """Batches of 64 events are counted, then the counts are added up."""
    e = P.table(spark, d, "events").groupBy("event_type", F.floor(F.col("event_id") / 64).alias("batch")).agg(F.count_if(F.col("value") > 0).alias("hit"), F.count(F.lit(1)).alias("n"))
    return evaluation.accumulated(e, ["event_type"], "hit", "n").select("event_type", "correct", "counted", r6("value"))


@query("x13_enumerated", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS at, o_orderstatus AS label FROM orders")
def x13_enumerated(spark, d):
    out = evaluation.enumerated(P.table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")
    return out.select("o_orderkey", F.col("target.index").alias("at"), F.col("target.label").alias("label"))


@query("f12_accepted_crop", "WITH c AS (SELECT l_orderkey AS image, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS ordinal, l_discount AS background FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY CASE WHEN background <= 0.03::DOUBLE THEN 0 ELSE 1 END, CASE WHEN background <= 0.03::DOUBLE THEN 0 ELSE background END, ordinal) AS n FROM c) SELECT image, min(ordinal) AS ordinal, round(min(background), 6) AS background FROM r WHERE n = 1 GROUP BY image")
def f12_accepted_crop(spark, d):
    line = P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") * F.lit(1000000000).cast("long") + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("ordinal"), F.col("l_discount").alias("background"))
    return provenance.accepted_crop(line, ["image"], "ordinal", "background", 0.03).select("image", "ordinal", r6("background"))


@query("f03_filter_report", "SELECT o_orderkey AS slide_id, CASE WHEN o_orderkey % 9 = 0 THEN 'excluded' WHEN o_orderkey % 4 = 0 THEN 'missing_filter' WHEN o_orderkey % 7 = 0 THEN 'unexpected_filter' ELSE 'filtered' END AS state FROM orders WHERE NOT (o_orderkey % 4 = 0 AND o_orderkey % 7 = 0)")
def f03_filter_report(spark, d):
    o = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("slide_id"))
    return provenance.filter_report(o.where("slide_id % 7 <> 0"), o.where("slide_id % 4 <> 0"), o.where("slide_id % 9 = 0"))


@query("s04_inspected", "SELECT o_orderkey AS slide, CASE WHEN o_orderkey % 5 = 0 THEN 'features are not a matrix' WHEN o_orderkey % 6 = 0 THEN 'coordinates are not pairs' WHEN o_orderkey % 8 = 0 THEN 'features and coordinates differ in length' WHEN o_custkey % 7 = 0 THEN 'no tiles' ELSE 'ok' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN 512 ELSE 256 END AS patch_size FROM orders")
def s04_inspected(spark, d):
    o = P.table(spark, d, "orders")
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 7
    shards = o.select(k.alias("slide"), F.when(k % 5 == 0, 3).otherwise(2).alias("feature_dims"), F.when(k % 6 == 0, 3).otherwise(2).alias("coord_columns"), n.alias("feature_rows"), F.when(k % 8 == 0, n + 1).otherwise(n).alias("coord_rows"), F.when(k % 3 == 0, "512").otherwise("none").alias("patch_size"), F.lit(None).cast("string").alias("target_patch_size"), F.lit(None).cast("string").alias("level0_magnification"), F.lit(None).cast("string").alias("target_magnification"))
    good, bad = provenance.inspected(shards, F.lit(20))
    return good.select("slide", F.lit("ok").alias("state"), "patch_size").unionByName(bad.select("slide", F.col("reason").alias("state"), "patch_size"))


@query("x06_due_tasks", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 = 0")
def x06_due_tasks(spark, d):
    """Results are there for a third of the tasks, some of which have other settings now."""
    tasks = P.table(spark, d, "orders").select("o_orderkey", F.lit(0.45).alias("coverage"))
    before = tasks.where("o_orderkey % 3 = 0").withColumn("coverage", F.when(F.col("o_orderkey") % 5 == 0, 0.5).otherwise(0.45))
    done = provenance.due_tasks(before, spark.createDataFrame([], "fingerprint string"), ["o_orderkey", "coverage"])
    return provenance.due_tasks(tasks, done, ["o_orderkey", "coverage"]).select("o_orderkey")


@query("x08_cluster_members", "SELECT l_suppkey % 16 AS cluster, l_orderkey // 1000 AS block, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS total, min(l_orderkey) AS first FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) GROUP BY ALL")
def x08_cluster_members(spark, d):
    rows = P.table(spark, d, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("row")).distinct().select((F.col("l_suppkey") % 16).alias("cluster"), "row")
    out = provenance.cluster_members(rows, block=1000)
    return out.select("cluster", "block", F.size("rows").cast("long").alias("n"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("rows")[0].alias("first"))
