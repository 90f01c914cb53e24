"""Logistic-regression probes over a range of inverse strengths."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The range of inverse strengths, 45 powers of ten.
STRENGTHS = [10 ** (-6 + 11 * i / 44) for i in range(45)]


def fit(train: DataFrame, c: float, iterations: int = 100, vector: str = "embedding"):
    """An L2 model of inverse strength c; label is a double."""
    n = max(1, train.count())
    return LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=iterations, featuresCol="_v").fit(train.withColumn("_v", array_to_vector(vector)))


def sweep(rows: DataFrame, strengths: list[float], iterations: int = 100, vector: str = "embedding") -> DataFrame:
    """c and accuracy on the rows outside is_train."""
    train, test, out = rows.where("is_train"), rows.where("not is_train"), None
    for c in strengths:
        scored = fit(train, c, iterations, vector).transform(test.withColumn("_v", array_to_vector(vector)))
        part = scored.agg(F.lit(float(c)).alias("c"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 6).alias("accuracy"))
        out = part if out is None else out.unionByName(part)
    return out
