"""Joins and checks between artifacts: assignments, known clusters, coordinates, evidence, bucket documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import text as X
from lamina.sources.files import guard


def with_assignment(tiles: DataFrame, assignments: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Tiles with their fine cluster by packed row, and its coarse one. The hierarchy has a row for each cluster."""
    out = tiles.join(assignments, ["magnification", "packed_row_index"])
    return out.join(F.broadcast(hierarchy), ["magnification", "fine_cluster_id"])


def unknown_clusters(tiles: DataFrame, known: DataFrame) -> DataFrame:
    """Cells of tiles that the cluster table does not have, or has under another coarse cluster."""
    cells = tiles.groupBy("magnification", "fine_cluster_id", "coarse_cluster_id").agg(F.count(F.lit(1)).alias("n_tiles"))
    return cells.join(known.select("magnification", "fine_cluster_id", "coarse_cluster_id"), ["magnification", "fine_cluster_id", "coarse_cluster_id"], "left_anti")


def coordinate_differences(raw: DataFrame, projected: DataFrame) -> DataFrame:
    """slide_id, rows, differing, raw_only, projected_only: raw and projected coordinates row by row."""
    a, b = raw.select("slide_id", "row", F.struct("x", "y").alias("a")), projected.select("slide_id", "row", F.struct("x", "y").alias("b"))
    both = a.join(b, ["slide_id", "row"], "full")
    return both.groupBy("slide_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("differing"), F.count_if(F.col("b").isNull()).alias("raw_only"), F.count_if(F.col("a").isNull()).alias("projected_only"))


def selected_representatives(selection: DataFrame, representatives: DataFrame) -> DataFrame:
    """Representatives of selected clusters, with the buckets that chose them, by rank."""
    chosen = selection.groupBy("magnification", "fine_cluster_id").agg(F.array_sort(F.collect_set("bucket")).alias("audit_buckets"))
    return representatives.join(F.broadcast(chosen), ["magnification", "fine_cluster_id"])


def by_stem(inputs: DataFrame, slides: DataFrame) -> DataFrame:
    """Inputs with the one slide file of their stem; none or several are errors."""
    a = inputs.withColumn("stem", X.without_patch_suffix(X.stem(F.col("path"))))
    b = slides.select(F.col("path").alias("slide_path"), X.stem(F.col("path")).alias("stem"))
    guard(b.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "ambiguous slides")
    guard(a.join(b, "stem", "left_anti").select("stem"), "slides are missing")
    return a.join(b, "stem")


def class_labels(entries: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Entries with their class name, null where the table of classes has none."""
    return entries.join(F.broadcast(labels), key, "left")


def dictionary_encoded(rows: DataFrame, column: str, into: str) -> DataFrame:
    """Values replaced by their position among the sorted distinct ones."""
    return rows.join(X.numbered(rows.select(column).distinct(), column, into), column)


def document_differences(clusters: DataFrame, document: DataFrame) -> DataFrame:
    """Memberships that only the table or only the document has. document: magnification, bucket, fine_cluster_ids."""
    a = clusters.select("magnification", F.explode("bucket_memberships").alias("bucket"), "fine_cluster_id")
    b = document.select("magnification", "bucket", F.explode("fine_cluster_ids").alias("fine_cluster_id"))
    return a.exceptAll(b).withColumn("only", F.lit("table")).unionByName(b.exceptAll(a).withColumn("only", F.lit("document")))


def evidence(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Render rows with the state of their file: ok, missing or changed. rows: path, sha256; files: path, content."""
    have = files.select("path", F.sha2("content", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed").otherwise("ok")
    return rows.join(have, "path", "left").withColumn("state", state).drop("found")


def prompt_faults(prompts: DataFrame, fields: tuple[str, ...] = ("polarity", "category", "concept_id")) -> DataFrame:
    """One row: rules of a concept table that are broken."""
    from lamina.functions import vectors as V

    blank = F.lit(False)
    for f in fields:
        blank |= F.coalesce(F.trim(f) == "", F.lit(True))
    sizes = F.size("embedding")
    return prompts.agg(
        F.count_if(~V.is_unit(F.col("embedding"), 1e-4)).alias("not_unit"),
        F.count_if(~V.finite(F.col("embedding"))).alias("not_finite"),
        F.count_if(blank).alias("blank"),
        (F.count(F.lit(1)) - F.count_distinct(*fields)).alias("repeated"),
        (F.max(sizes) - F.min(sizes)).cast("long").alias("size_range"),
    )


def mean_over_tries(results: DataFrame, keys: list[str], metric: str) -> DataFrame:
    return results.groupBy(*keys).agg(F.avg(metric).alias(metric), F.count(F.lit(1)).alias("tries"))


def applied(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: int = 1024) -> DataFrame:
    """A caller's model over bounded batches: projection of features, encoding of texts, or filters over tile pixels."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                yield function(part.iloc[i : i + batch])

    return rows.mapInPandas(run, schema)


def fixture_vectors(keys: DataFrame, key: str, dim: int = 64) -> DataFrame:
    """A unit vector for each key from a SHA-256 counter stream: reproducible fixtures, never data."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        import numpy as np

        for part in parts:
            out = []
            for k in part[key]:
                raw = b"".join(hashlib.sha256(f"{k}:{i}".encode()).digest() for i in range((dim * 4 + 31) // 32))
                v = np.frombuffer(raw, "<u4")[:dim].astype(float) / 2**31 - 1
                out.append((v / np.linalg.norm(v)).astype("float32"))
            yield pd.DataFrame({key: part[key], "embedding": out})

    return keys.select(key).mapInPandas(run, f"{key} {keys.schema[key].dataType.simpleString()}, embedding array<float>")
