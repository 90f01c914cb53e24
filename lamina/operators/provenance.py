"""Geometry, references, caches and reviews: rules that artifacts must keep."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.documents import canonical_hash
from lamina.sources.files import SourceError, guard

REFERENCE = re.compile(r"hf[_-]?hub?:(?P<repository>[\w.-]+/[\w.-]+)(?:@(?P<revision>[\w./-]+))?$|hf:(?P<short>[\w.-]+/[\w.-]+)(?:@(?P<pin>[\w./-]+))?$")


def positive_integer(value: Column) -> Column:
    """The value as a positive whole number, null if it is anything else."""
    number = value.cast("double")
    return F.when((number > 0) & (number == F.floor(number)) & (number < 2**31), number.cast("int"))


def tile_geometry(shards: DataFrame, magnification: Column) -> DataFrame:
    """Shards with patch_size, patch_size_level0 and target_magnification as positive integers; a size that is none, or a recorded magnification other than the configured one, is an error."""
    fields = ("patch_size", "patch_size_level0", "target_magnification")
    out = shards.withColumns({c: positive_integer(F.col(c)) for c in fields})
    guard(out.where(F.greatest(*[F.col(c).isNull() for c in fields])), "geometry is not of positive integers")
    guard(out.where(F.col("target_magnification") != magnification), "recorded magnification differs")
    return out


def inspected(shards: DataFrame, default_magnification: Column) -> tuple[DataFrame, DataFrame]:
    """Usable shards and the others with a reason. shards: path, feature_rows, feature_dims, coord_rows, coord_columns and the recorded sizes; sizes that are missing take 256, 256, 0 and the magnification."""
    number = lambda c, default: F.coalesce(F.expr(f"try_cast(`{c}` as int)"), default)
    out = shards.withColumns(
        {
            "patch_size": number("patch_size", F.lit(256)),
            "target_patch_size": number("target_patch_size", F.lit(256)),
            "level0_magnification": number("level0_magnification", F.lit(0)),
            "target_magnification": number("target_magnification", default_magnification),
        }
    )
    reason = (
        F.when(F.coalesce(F.col("feature_dims") != 2, F.lit(True)), "features are not a matrix")
        .when(F.coalesce(F.col("coord_columns") != 2, F.lit(True)), "coordinates are not pairs")
        .when(F.col("feature_rows") != F.col("coord_rows"), "features and coordinates differ in length")
        .when(F.col("feature_rows") == 0, "no tiles")
    )
    out = out.withColumn("reason", reason)
    return out.where("reason is null").drop("reason").withColumn("n_tiles", F.col("feature_rows")), out.where("reason is not null")


def coordinates_only(shards: DataFrame) -> DataFrame:
    """Shards of coordinates; empty and misshapen ones are dropped without notice."""
    return shards.where("coord_rows > 0 and coord_columns = 2").withColumn("n_tiles", F.col("coord_rows"))


def by_magnification(files: DataFrame, configured: list[int]) -> DataFrame:
    """Tile files with the magnification of their partition folder; the folders must be just the configured ones."""
    out = files.withColumn("magnification", F.regexp_extract("path", r"mag_partition=(\d+)x/[^/]+$", 1).cast("int"))
    have = {r[0] for r in out.select("magnification").distinct().collect()}  # one row for each folder
    if have != set(configured):
        raise SourceError(f"magnifications {sorted(map(str, have))} are not {sorted(configured)}")
    return out


def accepted_crop(candidates: DataFrame, image: list[str], ordinal: str, background: str, limit: float) -> DataFrame:
    """The crop of each image: the first candidate whose share of background is within the limit, else the one of least background (the first of equals)."""
    order = F.struct(F.when(F.col(background) <= limit, F.struct(F.lit(0).alias("late"), F.lit(0.0).alias("share"))).otherwise(F.struct(F.lit(1).alias("late"), F.col(background).cast("double").alias("share"))), F.col(ordinal))
    others = [c for c in candidates.columns if c not in image]
    best = candidates.groupBy(*image).agg(F.min_by(F.struct(*others), order).alias("b"))
    return best.select(*image, "b.*")


def due_tasks(tasks: DataFrame, results: DataFrame, fields: list[str]) -> DataFrame:
    """Tasks without a result of the same fingerprint; a fingerprint hashes what the result depends on. results: fingerprint."""
    made = tasks.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*sorted(fields))), 256))
    return made.join(results.select("fingerprint").distinct(), "fingerprint", "left_anti")


def filter_report(features: DataFrame, filters: DataFrame, excluded: DataFrame, key: str = "slide_id") -> DataFrame:
    """key and state of every slide: filtered, excluded, missing_filter or unexpected_filter. Filters without features are expected only of excluded slides."""
    a = features.select(key).distinct().withColumn("a", F.lit(1))
    b = filters.select(key).distinct().withColumn("b", F.lit(1))
    c = excluded.select(key).distinct().withColumn("c", F.lit(1))
    both = a.join(b, key, "full").join(c, key, "left")
    state = F.when(F.col("c").isNotNull(), "excluded").when(F.col("b").isNull(), "missing_filter").when(F.col("a").isNull(), "unexpected_filter").otherwise("filtered")
    return both.select(key, state.alias("state"))


def exclusion_report(shards: DataFrame) -> DataFrame:
    """magnification, slide, sizes and reason of excluded shards, in path order inside files."""
    return shards.select("target_magnification", "slide_id", "path", "level0_magnification", "n_tiles", F.lit("target_magnification_above_scan").alias("reason")).sortWithinPartitions("target_magnification", "path")


def cluster_members(assignments: DataFrame, cluster: str = "cluster", row: str = "row", block: int = 100_000) -> DataFrame:
    """cluster, block, rows: row numbers of each cluster in ascending order, in blocks of consecutive row ranges, so that a cluster of any size is no single array."""
    dealt = assignments.withColumn("block", F.floor(F.col(row) / block))
    return dealt.groupBy(cluster, "block").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def model_reference(text: str, production: bool) -> dict[str, str | None]:
    """Repository and revision of a hub reference; production must pin a revision."""
    found = REFERENCE.match(text)
    if not found:
        raise SourceError(f"model reference {text!r}")
    out = {"repository": found["repository"] or found["short"], "revision": found["revision"] or found["pin"]}
    if production and not out["revision"]:
        raise SourceError(f"{text!r} names no revision")
    return out


def contract(kind: str, **facts) -> dict:
    """An identity payload with its hash."""
    payload = {"kind": kind} | facts
    return payload | {"sha256": canonical_hash(payload)}


def index_kind(size: int) -> str:
    """The narrowest Spark type that numbers `size` rows."""
    return "int" if size <= 2**31 else "long"


def picked(rows: DataFrame, path: str, into: str) -> DataFrame:
    """A nested field by its dotted path."""
    column = F.col(path.split(".")[0])
    for part in path.split(".")[1:]:
        column = column.getField(part)
    return rows.withColumn(into, column)


def completed_review(selection: DataFrame, review: DataFrame, reviewer: str, acknowledged: bool) -> DataFrame:
    """A review in which every selected cluster passes, made by a program: only with an explicit acknowledgement, and only if no row was filled in before."""
    if not acknowledged:
        raise SourceError("automatic completion of a review needs an explicit acknowledgement")
    guard(review.where("coalesce(trim(decision), '') <> '' or coalesce(trim(reviewer), '') <> ''"), "rows are filled in already")
    last = F.row_number().over(Window.partitionBy("cluster_key").orderBy("cluster_key"))
    once = selection.select("cluster_key").withColumn("_n", last).where("_n = 1").drop("_n")
    return once.withColumns({"decision": F.lit("pass"), "reviewer": F.lit(reviewer), "automatic": F.lit(True)})
