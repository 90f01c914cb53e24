"""Evaluation over many settings at once: probe grids, accumulators, reduced losses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.neighbours import vectors_of


def reduced(losses: DataFrame, step: str = "step", name: str = "name", value: str = "value") -> DataFrame:
    """Loss dictionaries of all ranks as one row for each step and name: mean, sum and number of ranks; names ascending within the total of a step."""
    by = losses.groupBy(step, name).agg(F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.count(value).alias("ranks"))
    return by.withColumn("total", F.sum("mean").over(Window.partitionBy(step)))


def accumulated(batches: DataFrame, keys: list[str], correct: str, counted: str) -> DataFrame:
    """Metrics that are updated batch by batch and computed once: the share of correct ones for each key."""
    return batches.groupBy(*keys).agg(F.sum(correct).alias("correct"), F.sum(counted).alias("counted"), (F.sum(correct) / F.sum(counted)).alias("value"))


def enumerated(rows: DataFrame, key: str, target: str, into: str = "target") -> DataFrame:
    """Rows whose target also carries their position in the order of a distinct key, so that results can be scattered back."""
    from lamina.functions.text import numbered

    return rows.join(numbered(rows.select(key), key, "_at"), key).withColumn(into, F.struct(F.col("_at").alias("index"), F.col(target).alias("label"))).drop("_at")


def scattered(results: DataFrame, index: str = "index") -> DataFrame:
    """One row for each index; rows that a sampler repeated to fill its last batch are the same, and go."""
    return results.dropDuplicates([index])


def probe_grid(train: DataFrame, test: DataFrame, rates: list[float], blocks: dict[str, tuple[int, int]], classes: int, steps: int = 100, momentum: float = 0.9, vector: str = "embedding", label: str = "label") -> DataFrame:
    """block, rate, accuracy: linear probes for every learning rate and every block (a range of dimensions).

    All probes are trained together: a step is one pass over the training rows,
    in which each task sums every probe's gradient, so neither rows nor scores
    reach the driver, which holds the probes' weights: settings times classes
    times dimensions. Rates fall along a half cosine; the best of a block is the
    first of the greatest accuracy.
    """
    spark = train.sparkSession
    names = [(b, r) for b in sorted(blocks) for r in rates]
    weights = [np.zeros((classes, blocks[b][1] - blocks[b][0] + 1)) for b, _ in names]
    speed = [np.zeros_like(w) for w in weights]
    rows = train.select(F.col(vector).alias("v"), F.col(label).cast("long").alias("y")).persist()
    n = rows.count()

    def inputs(batch: pa.RecordBatch):
        x, y = vectors_of(batch.column(0)), np.asarray(batch.column(1))
        return {b: np.c_[x[:, i:j], np.ones(len(x))] for b, (i, j) in blocks.items()}, y

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for step in range(steps):
        shared = spark.sparkContext.broadcast(weights)

        def gradients(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = [np.zeros_like(w) for w in shared.value]
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, y = inputs(batch)
                for g, w, (b, _) in zip(total, shared.value, names, strict=True):
                    p = softmax(x[b] @ w.T)
                    p[np.arange(len(y)), y] -= 1
                    g += p.T @ x[b]
            flat = np.concatenate([g.ravel() for g in total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "g"])

        found = rows.mapInArrow(gradients, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).toArrow().sort_by("i")
        flat, at = np.asarray(found.column("g")), 0
        for k, (w, (_, rate)) in enumerate(zip(weights, names, strict=True)):
            g = flat[at : at + w.size].reshape(w.shape) / max(1, n)
            at += w.size
            speed[k] = momentum * speed[k] + g
            weights[k] = w - rate * (1 + np.cos(np.pi * step / steps)) / 2 * speed[k]
        shared.unpersist()
    rows.unpersist()
    final = spark.sparkContext.broadcast(weights)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, seen = np.zeros(len(names), np.int64), 0
        for batch in batches:
            if batch.num_rows:
                x, y = inputs(batch)
                right += [int(((x[b] @ w.T).argmax(1) == y).sum()) for w, (b, _) in zip(final.value, names, strict=True)]
                seen += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in names]), pa.array([float(r) for _, r in names]), pa.array(right), pa.array(np.full(len(names), seen))], names=["block", "rate", "right", "seen"])

    scored = test.select(F.col(vector).alias("v"), F.col(label).cast("long").alias("y")).mapInArrow(hits, "block string, rate double, right long, seen long")
    return scored.groupBy("block", "rate").agg((F.sum("right") / F.sum("seen")).alias("accuracy"))
