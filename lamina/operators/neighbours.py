"""Nearest neighbours, votes, accuracies, representatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 64 << 20


def vectors_of(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def best_of(names: np.ndarray, matrix: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray]], k: int, skip_self: bool, digits: int) -> pa.RecordBatch:
    """The k best of the rows in parts (keys, vectors) for each query."""
    best_s, best_i = np.full((len(names), 0), -np.inf), np.zeros((len(names), 0), np.int64)
    for other, vectors in parts:
        s = np.round(matrix @ vectors.T, digits)
        if skip_self:
            s[names[:, None] == other[None, :]] = -np.inf
        s, i = np.c_[best_s, s], np.c_[best_i, np.broadcast_to(other, s.shape)]
        order = np.lexsort((i, -s), axis=1)[:, :k]
        best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
    good = np.isfinite(best_s).ravel()
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(names, best_s.shape[1])[good]), pa.array(best_i.ravel()[good]), pa.array(best_s.ravel()[good])], names=["query", "neighbour", "similarity"])


def top_k(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", skip_self: bool = False, digits: int = 9, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query, neighbour, similarity, rank: the k rows of greatest inner product (least key of equals).

    The stated queries are measured first. If they fit in `block_bytes`, they are
    broadcast and the rows are not shuffled; else both sides are dealt to blocks
    of that size by key, and every block of queries meets every block of rows in
    a task of its own. Each task keeps its k best for every query, and only
    these meet.
    """
    spark, kinds = rows.sparkSession, "query long, neighbour long, similarity double"
    asked, held = queries.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")), rows.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    weight = lambda frame: frame.agg(F.sum(F.size("v") * 8 + 8)).first()[0] or 0
    pieces = lambda table: ((np.asarray(b.column(0)), vectors_of(b.column(1))) for b in table.to_batches(max_chunksize=4096) if b.num_rows)
    size = weight(asked)
    if size <= block_bytes:
        table = asked.orderBy("key").toArrow()  # at most block_bytes
        shared = spark.sparkContext.broadcast((np.asarray(table.column(0)), vectors_of(table.column(1))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, matrix = shared.value
            if len(names):
                parts = (p for b in batches for p in pieces(pa.Table.from_batches([b])))
                yield best_of(names, matrix, parts, k, skip_self, digits)

        out = held.mapInArrow(run, kinds)
    else:
        n_asked, n_held = -(-size // block_bytes), max(1, -(-weight(held) // block_bytes))
        block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
        left = asked.withColumn("q", block(n_asked)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(int(n_held - 1)))))
        right = held.withColumn("r", block(n_held)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(int(n_asked - 1)))))

        def meet(one: pa.Table, two: pa.Table) -> pa.Table:
            if not one.num_rows or not two.num_rows:
                return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query", "neighbour", "similarity"])
            return pa.Table.from_batches([best_of(np.asarray(one.column("key")), vectors_of(one.column("v")), pieces(two.select(["key", "v"])), k, skip_self, digits)])

        out = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(meet, kinds)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def votes(neighbours: DataFrame, labels: DataFrame, ks: list[int], temperature: float = 0.07) -> DataFrame:
    """query, k, label, weight: softmax of similarity over temperature across all neighbours, summed over the first k of them."""
    w = Window.partitionBy("query")
    weight = F.exp((F.col("similarity") - F.max("similarity").over(w)) / temperature)
    named = neighbours.withColumn("w", weight).withColumn("w", F.col("w") / F.sum("w").over(w)).join(labels.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour")
    each = named.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    return each.groupBy("query", "k", "label").agg(F.sum("w").alias("weight"))


def predictions(votes: DataFrame, digits: int = 9) -> DataFrame:
    """query, k, labels by descending weight (least label of equals)."""
    return votes.groupBy("query", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.round("weight", digits)).alias("w"), F.col("label")))), lambda x: x["label"]).alias("labels"))


def hits(predicted: DataFrame, truth: DataFrame, tops: list[int]) -> DataFrame:
    """query, k, label, top, hit: whether the label is among the first `top` predictions."""
    each = predicted.join(truth.select(F.col("vec_id").alias("query"), "label"), "query").withColumn("top", F.explode(F.array(*map(F.lit, tops))))
    return each.select("query", "k", "label", "top", F.array_contains(F.slice("labels", 1, F.col("top")), F.col("label")).cast("int").alias("hit"))


def accuracies(hits: DataFrame) -> DataFrame:
    """k, top, micro and macro accuracy."""
    by = hits.groupBy("k", "top", "label").agg(F.sum("hit").alias("h"), F.count(F.lit(1)).alias("n"))
    return by.groupBy("k", "top").agg((F.sum("h") / F.sum("n")).alias("micro"), F.avg(F.col("h") / F.col("n")).alias("macro"))


def multi_label_accuracy(predicted: DataFrame, truth: DataFrame, top: int) -> DataFrame:
    """Share of rows with a true label among the first predictions; rows without labels are left out. truth: query, true_labels."""
    each = predicted.join(truth.where(F.size("true_labels") > 0), "query")
    return each.groupBy("k").agg(F.avg(F.arrays_overlap(F.slice("labels", 1, top), F.col("true_labels")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def best_by(rows: DataFrame, metric: str, ordinal: str, take: list[str], group: list[str] | None = None) -> DataFrame:
    """The row of the greatest metric, the first by ordinal among equals."""
    best = F.min_by(F.struct(*take, metric), F.struct(-F.col(metric), F.col(ordinal)))
    return rows.groupBy(*(group or [])).agg(best.alias("b")).select(*(group or []), "b.*")


def representatives(rows: DataFrame, per_slide: int = 2, per_cluster: int = 20) -> DataFrame:
    """The best rows of each cluster with at most per_slide of a slide. rows: cluster, slide, row, score."""
    inside = Window.partitionBy("cluster", "slide").orderBy(F.desc("score"), "row")
    whole = Window.partitionBy("cluster").orderBy(F.desc("score"), "row")
    kept = rows.withColumn("_n", F.row_number().over(inside)).where(F.col("_n") <= per_slide).drop("_n")
    return kept.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= per_cluster)
