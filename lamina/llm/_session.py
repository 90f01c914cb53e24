"""Session settings that several operators read."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm._arrow import lean


def ready(spark: SparkSession) -> SparkSession:
    """Makes checkpoint() usable: the cluster's spark.checkpoint.dir, or, where it is unset and everything runs in one process (tests), a folder of this machine. Elsewhere an unset folder is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="lamina-checkpoint-")
        context.setCheckpointDir(shared)
    return spark


def named(column: str) -> Column:
    """A top-level column by its literal name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_rows(docs: DataFrame, into: str = "row") -> Column:
    """All columns as one struct, so that names inside an operator cannot clash with the table's."""
    return F.struct(*[named(c).alias(c) for c in docs.columns]).alias(into)


def unpacked(columns: list[str], row: str = "row", **replaced: Column) -> list[Column]:
    """The fields of a whole_rows() struct under their names, some replaced."""
    return [replaced.get(c, F.col(row).getField(c)).alias(c) for c in columns]


def bytes_of(frame: DataFrame) -> int:
    """The optimiser's estimate of a plan's size in bytes; nothing runs for it."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def tasks_for(frame: DataFrame, each: int) -> int:
    """A number of partitions that follows the data: one for each `each` bytes, the session's at least. A size that is not known (a plan without statistics) counts as none."""
    spark, size = frame.sparkSession, bytes_of(frame)
    return max(partitions(spark), min(-(-size // each), MOST_TASKS) if size < UNKNOWN else 0)


#: A plan whose size the optimiser does not know is taken to have more bytes than this.
UNKNOWN = 1 << 58
MOST_TASKS = 200_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(frame: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches bounded in bytes (8 MB unless the session says otherwise), as texts may be long, and workers that give memory back."""
    spark = frame.sparkSession
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    return frame.mapInArrow(lean(run), schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut, its rows in the shared checkpoint folder."""
    ready(frame.sparkSession)
    return frame.checkpoint()
