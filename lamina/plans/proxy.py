"""The domain on the driver's tables: a tile is a line item, a slide an order, a patient a customer.

Each function has the same rows in SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATEGORIES = ["architecture", "tissue_compartment", "pathology_state", "cellular_nuclear", "scale_context", "anatomical_structures", "tissue_identity", "artifact_quality"]
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def magnification(line: str = "l_linenumber"):
    return F.element_at(F.array(*map(F.lit, (5, 10, 20, 40))), F.col(line) % 4 + 1)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each tile with its slide, patient, site, project and clusters. Dimensions are joined as the optimiser sees fit; tiles meet orders once."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    fine = F.substring("p_brand", 7, 10).cast("int")
    out = line.join(part, line.l_partkey == part.p_partkey).join(orders, line.l_orderkey == orders.o_orderkey)
    out = out.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select(
        magnification().alias("magnification"),
        fine.alias("fine_cluster_id"),
        (fine % 5).alias("coarse_cluster_id"),
        F.col("l_orderkey").alias("slide_id"),
        F.col("o_custkey").alias("patient_id"),
        F.col("n_name").alias("primary_site"),
        F.col("r_name").alias("tcga_project"),
        F.floor("l_extendedprice").cast("long").alias("x"),
        F.col("l_partkey").alias("y"),
        F.col("l_quantity").alias("quantity"),
        "l_returnflag",
        *[F.col(c) for c in KEYS],
    )


TILES = """
tiles AS (
  SELECT [5, 10, 20, 40][l_linenumber % 4 + 1] AS magnification, CAST(substr(p_brand, 7) AS INT) AS fine_cluster_id, CAST(substr(p_brand, 7) AS INT) % 5 AS coarse_cluster_id,
    l_orderkey AS slide_id, o_custkey AS patient_id, n_name AS primary_site, r_name AS tcga_project,
    CAST(floor(l_extendedprice) AS BIGINT) AS x, l_partkey AS y, l_quantity AS quantity, l.*
  FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def packed_rows(tiles: DataFrame) -> DataFrame:
    """Adds packed_row_index, the position among all tiles in the order of slide and key. Slides start where the ones before them end; these totals are summed in two levels, so nothing is ordered as a whole."""
    from lamina.operators.index import offsets

    slides = tiles.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.floor(F.col("slide_id") / 1024))
    starts = offsets(slides, ["slide_id"], "n", "row_start", "row_end", ["range"]).select("slide_id", "row_start")
    place = F.row_number().over(Window.partitionBy("slide_id").orderBy(*KEYS[1:])) - 1
    return tiles.withColumn("at", place).join(starts, "slide_id").withColumn("packed_row_index", F.col("at") + F.col("row_start")).drop("at", "row_start")


PACKED = f"packed AS (SELECT *, row_number() OVER (ORDER BY slide_id, {', '.join(KEYS[1:])}) - 1 AS packed_row_index FROM tiles)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("fine_cluster_id"), (F.col("label") % 3).alias("coarse_cluster_id"))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 vectors as concepts, a bank of fixed size."""
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("vec_id") % 8 + 1).cast("int"))
    polarity = F.when(category == "artifact_quality", "negative").when(category == "tissue_identity", "analysis").otherwise("positive")
    return table(spark, sf_dir, "embeddings").where("vec_id < 40").select(F.col("vec_id").alias("concept_id"), category.alias("category"), polarity.alias("polarity"), "embedding")


#: Long form: centroid dims of fine clusters, unit concepts, cosines, z-scores and percentiles, category and artifact scores.
SEMANTIC = """
dims AS (SELECT label AS fine_cluster_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
sums AS (SELECT fine_cluster_id, dim, sum(v) AS total, count(*) AS n FROM dims GROUP BY fine_cluster_id, dim),
cent AS (SELECT fine_cluster_id, dim, n, total / sqrt(sum(total * total) OVER (PARTITION BY fine_cluster_id)) AS v FROM sums),
cdim AS (SELECT vec_id AS concept_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings WHERE vec_id < 40),
cunit AS (SELECT concept_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY concept_id)) AS v FROM cdim),
cat AS (SELECT vec_id AS concept_id, ['architecture','tissue_compartment','pathology_state','cellular_nuclear','scale_context','anatomical_structures','tissue_identity','artifact_quality'][vec_id % 8 + 1] AS category FROM embeddings WHERE vec_id < 40),
pol AS (SELECT *, CASE category WHEN 'artifact_quality' THEN 'negative' WHEN 'tissue_identity' THEN 'analysis' ELSE 'positive' END AS polarity FROM cat),
cos AS (SELECT fine_cluster_id, concept_id, round(sum(cent.v * cunit.v), 9) AS raw_cosine FROM cent JOIN cunit USING (dim) GROUP BY fine_cluster_id, concept_id),
std AS (SELECT *, CASE WHEN stddev_pop(raw_cosine) OVER w > 0 THEN (raw_cosine - avg(raw_cosine) OVER w) / stddev_pop(raw_cosine) OVER w ELSE 0 END AS z_score,
    CASE WHEN count(*) OVER w = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY concept_id ORDER BY raw_cosine) + (count(*) OVER (PARTITION BY concept_id, raw_cosine) - 1) / 2 - 1) / (count(*) OVER w - 1) END AS percentile_score
  FROM cos WINDOW w AS (PARTITION BY concept_id)),
scored AS (SELECT std.*, category, polarity FROM std JOIN pol USING (concept_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY fine_cluster_id, category ORDER BY percentile_score DESC, concept_id) AS rn FROM scored WHERE (polarity = 'positive' OR category = 'tissue_identity') AND category <> 'artifact_quality'),
catscore AS (SELECT fine_cluster_id, category, avg(percentile_score) AS score FROM best WHERE rn <= 3 GROUP BY fine_cluster_id, category),
art AS (SELECT fine_cluster_id, max(percentile_score) FILTER (WHERE polarity = 'negative' AND category = 'artifact_quality') AS artifact_score FROM scored GROUP BY fine_cluster_id),
summary AS (SELECT fine_cluster_id, max(score) FILTER (category = 'architecture') AS architecture_score, max(score) FILTER (category = 'tissue_compartment') AS compartment_score,
    max(score) FILTER (category = 'pathology_state') AS pathology_score, max(score) FILTER (category = 'cellular_nuclear') AS cellular_score, max(score) FILTER (category = 'scale_context') AS scale_context_score,
    max(score) FILTER (category = 'anatomical_structures') AS anatomical_structures_score, max(score) FILTER (category = 'tissue_identity') AS tissue_identity_score, max(artifact_score) AS artifact_score
  FROM catscore JOIN art USING (fine_cluster_id) GROUP BY fine_cluster_id)"""


def stats_sql(level: str) -> str:
    """Statistics of a level, from tiles."""
    return f"""
bypat AS (SELECT magnification, {level}, primary_site, patient_id, count(*) AS n FROM tiles GROUP BY ALL),
site AS (SELECT magnification, {level}, primary_site, sum(n) AS n, count(*) AS np FROM bypat GROUP BY ALL),
proj AS (SELECT magnification, {level}, tcga_project, count(*) AS n FROM tiles GROUP BY ALL),
ksite AS (SELECT magnification, count(DISTINCT primary_site) AS k FROM site GROUP BY ALL),
kproj AS (SELECT magnification, count(DISTINCT tcga_project) AS k FROM proj GROUP BY ALL),
esite AS (SELECT magnification, {level}, sum(n) AS n_tiles, CASE WHEN max(k) <= 1 THEN 0 ELSE -sum(n / t * ln(n / t)) / ln(max(k)) END + 0.0 AS tissue_entropy,
    count(*) FILTER (n >= 20 AND np >= 3) AS tissue_coverage, max(k) AS k, arg_min(primary_site, (-n, primary_site)) AS dominant_tissue, max(n) / sum(n) AS dominant_tissue_fraction, count(*) AS n_tissues
  FROM (SELECT *, sum(n) OVER (PARTITION BY magnification, {level}) AS t FROM site) JOIN ksite USING (magnification) GROUP BY magnification, {level}),
eproj AS (SELECT magnification, {level}, CASE WHEN max(k) <= 1 THEN 0 ELSE -sum(n / t * ln(n / t)) / ln(max(k)) END + 0.0 AS project_entropy, arg_min(tcga_project, (-n, tcga_project)) AS dominant_project, max(n) / sum(n) AS dominant_project_fraction, count(*) AS n_projects
  FROM (SELECT *, sum(n) OVER (PARTITION BY magnification, {level}) AS t FROM proj) JOIN kproj USING (magnification) GROUP BY magnification, {level}),
dist AS (SELECT magnification, {level}, count(DISTINCT patient_id) AS n_patients, count(DISTINCT slide_id) AS n_slides FROM tiles GROUP BY ALL),
stats AS (SELECT *, CASE WHEN max(tissue_coverage) OVER m > 0 THEN tissue_coverage / max(tissue_coverage) OVER m ELSE 0 END AS tissue_coverage_norm, tissue_coverage / k AS tissue_coverage_fraction,
    ln(1 + n_patients) / ln(1 + max(n_patients) OVER m) AS patient_support, ln(1 + n_slides) / ln(1 + max(n_slides) OVER m) AS slide_support,
    least(greatest(sqrt(median(n_tiles) OVER m / n_tiles), 0.5), 3.0) AS rarity_score
  FROM esite JOIN eproj USING (magnification, {level}) JOIN dist USING (magnification, {level}) WINDOW m AS (PARTITION BY magnification))"""


COMPOSITE = """
base AS (SELECT stats.*, sm.* EXCLUDE (fine_cluster_id), 1 - artifact_score AS cleanliness,
    0.3::DOUBLE * architecture_score + 0.2::DOUBLE * compartment_score + 0.2::DOUBLE * pathology_score + 0.15::DOUBLE * cellular_score + 0.15::DOUBLE * scale_context_score AS useful_score
  FROM stats JOIN summary sm ON stats.fine_cluster_id % 10 = sm.fine_cluster_id),
comp AS (SELECT *, round(useful_score * cleanliness, 9) AS clean_score,
    round(useful_score * cleanliness * tissue_entropy * tissue_coverage_norm * patient_support, 9) AS bridge_score,
    round(architecture_score * tissue_entropy * tissue_coverage_norm * patient_support * cleanliness, 9) AS architecture_bridge_score,
    round(architecture_score * (1 - tissue_entropy) * patient_support * cleanliness, 9) AS architecture_specific_score,
    round(rarity_score * useful_score * cleanliness * patient_support * cleanliness, 9) AS rare_clean_score,
    round(useful_score * cleanliness * (1 - tissue_entropy) * patient_support, 9) AS tissue_specific_score FROM base),
elig AS (SELECT *, artifact_score > 0.8::DOUBLE AS is_artifact_excluded, n_patients < 5 AS is_support_excluded, NOT (artifact_score > 0.8::DOUBLE) AND NOT (n_patients < 5) AS sampling_eligible FROM comp),
thr AS (SELECT magnification, {thr} FROM elig GROUP BY magnification),
bucketed AS (SELECT *,
    sampling_eligible AND bridge_score >= bridge_score_threshold AND artifact_score < 0.7::DOUBLE AND n_patients >= 10 AND tissue_coverage >= 3 AS is_bridge,
    sampling_eligible AND architecture_bridge_score >= architecture_bridge_score_threshold AND artifact_score < 0.7::DOUBLE AND n_patients >= 10 AND tissue_coverage >= 3 AND architecture_score >= 0.7::DOUBLE AS is_architecture_bridge,
    sampling_eligible AND architecture_specific_score >= architecture_specific_score_threshold AND artifact_score < 0.7::DOUBLE AND n_patients >= 10 AND tissue_coverage >= 3 AND architecture_score >= 0.7::DOUBLE AND tissue_entropy <= {entropy}::DOUBLE AS is_architecture_specific,
    sampling_eligible AND rare_clean_score >= rare_clean_score_threshold AND artifact_score < 0.6::DOUBLE AND n_patients >= 5 AS is_rare_clean,
    sampling_eligible AND tissue_specific_score >= tissue_specific_score_threshold AND artifact_score < 0.7::DOUBLE AND n_patients >= 10 AND tissue_entropy <= {entropy}::DOUBLE AS is_tissue_specific
  FROM elig JOIN thr USING (magnification))"""
SCORE_NAMES = ["bridge_score", "architecture_bridge_score", "architecture_specific_score", "rare_clean_score", "tissue_specific_score"]


def composite_sql(entropy: float = 0.5) -> str:
    thr = ", ".join(f"quantile_cont({s}, 0.8) FILTER (sampling_eligible) AS {s}_threshold" for s in SCORE_NAMES)
    return COMPOSITE.replace("{thr}", thr).replace("{entropy}", str(entropy))


UNITS = 1 << 64


def random_sql(name: str, source: str, seed: int, stream: int, into: str) -> str:
    """CTEs that add a counter-based number of `draw` to the rows of `source`: unsigned arithmetic in 128 bits, taken modulo 2**64."""
    from lamina.functions import rng

    u = lambda n: f"{n}::UHUGEINT"
    mixed = f"(xor({u(seed)}, xor((draw::UHUGEINT * {u(rng.DRAW)}) % {u(UNITS)}, {u(stream * rng.STREAM % UNITS)})) + {u(rng.GOLDEN)}) % {u(UNITS)}"
    turn = lambda x, bits, by: f"(xor({x}, {x} // {u(1 << bits)}) * {u(by)}) % {u(UNITS)}"
    return f"""{name}_1 AS (SELECT *, {mixed} AS z1 FROM {source}),
{name}_2 AS (SELECT * EXCLUDE (z1), {turn("z1", 30, rng.FIRST)} AS z2 FROM {name}_1),
{name}_3 AS (SELECT * EXCLUDE (z2), {turn("z2", 27, rng.SECOND)} AS z3 FROM {name}_2),
{name} AS (SELECT * EXCLUDE (z3), xor(z3, z3 // {u(1 << 31)}) AS {into} FROM {name}_3)"""


def index_sql(number: str, size: str) -> str:
    return f"CAST(({number} * {size}::UHUGEINT) // {UNITS}::UHUGEINT AS BIGINT)"


def choice_sql(number: str, weights: dict) -> str:
    from lamina.functions import rng

    when = " ".join(f"WHEN CAST({number} AS DOUBLE) / {float(UNITS)!r}::DOUBLE < {bound!r}::DOUBLE THEN {key!r}" for key, bound in rng.shares(weights))
    return f"CASE {when} END"


def draws_sql(n: int, weights: dict) -> str:
    """Hierarchical draws of the random bucket: magnification, coarse cell, fine cell, slide, tile."""
    ordinal = lambda keys, by: f"row_number() OVER (PARTITION BY {keys} ORDER BY {by}) - 1"
    cell = "magnification, coarse_cluster_id, fine_cluster_id"
    return f"""{TILES}, {PACKED}, d0 AS (SELECT i AS draw FROM range({n}) t(i)),
{random_sql("d1", "d0", 7, 0, "r0")}, d2 AS (SELECT draw, {choice_sql("r0", weights)} AS magnification FROM d1),
coarse AS (SELECT *, {ordinal("magnification", "coarse_cluster_id")} AS coarse_at, count(*) OVER (PARTITION BY magnification) AS n_coarse FROM (SELECT magnification, coarse_cluster_id, count(DISTINCT fine_cluster_id) AS n_fine FROM tiles GROUP BY ALL)),
fine AS (SELECT *, {ordinal("magnification, coarse_cluster_id", "fine_cluster_id")} AS fine_at FROM (SELECT {cell}, count(DISTINCT slide_id) AS n_slides FROM tiles GROUP BY ALL)),
slides AS (SELECT *, {ordinal(cell, "slide_id")} AS slide_at FROM (SELECT {cell}, slide_id, count(*) AS n_entries FROM tiles GROUP BY ALL)),
entries AS (SELECT {cell}, slide_id, packed_row_index, {ordinal(cell + ", slide_id", "packed_row_index")} AS tile_at FROM packed),
{random_sql("d3", "d2", 7, 2, "r2")},
d4 AS (SELECT draw, d3.magnification, c.coarse_cluster_id, c.n_fine FROM d3 JOIN coarse c ON c.magnification = d3.magnification AND c.coarse_at = {index_sql("r2", "n_coarse")}),
{random_sql("d5", "d4", 7, 3, "r3")},
d6 AS (SELECT draw, f.* FROM d5 JOIN fine f ON f.magnification = d5.magnification AND f.coarse_cluster_id = d5.coarse_cluster_id AND f.fine_at = {index_sql("r3", "n_fine")}),
{random_sql("d7", "d6", 7, 4, "r4")},
d8 AS (SELECT draw, s.* FROM d7 JOIN slides s USING ({cell}) WHERE s.slide_at = {index_sql("r4", "n_slides")}),
{random_sql("d9", "d8", 7, 5, "r5")},
drawn AS (SELECT draw, e.magnification, 'random' AS bucket, e.coarse_cluster_id, e.fine_cluster_id, e.slide_id, e.packed_row_index FROM d9 JOIN entries e USING ({cell}, slide_id) WHERE e.tile_at = {index_sql("r5", "n_entries")})"""
