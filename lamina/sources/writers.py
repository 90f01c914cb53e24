"""Sinks: partitioned tables, atomic documents, entry exports, appends."""

from __future__ import annotations

import html
import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partitioned(tiles: DataFrame, path: str, column: str = "magnification") -> None:
    """Parquet in mag_partition=<m>x folders, sorted by packed row inside files, zstd."""
    out = tiles.withColumn("mag_partition", F.concat(F.col(column).cast("string"), F.lit("x")))
    out.repartition("mag_partition", F.floor(F.col("packed_row_index") / (1 << 22))).sortWithinPartitions("packed_row_index").write.mode("overwrite").option("compression", "zstd").partitionBy("mag_partition").parquet(path)


def staged(frame: DataFrame, path: str) -> None:
    """Parquet at path, all of it or none: written beside it, then renamed, on the session's file system."""
    spark = frame.sparkSession
    jvm, beside = spark._jvm, f"{path.rstrip('/')}.partial"
    place, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(beside)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    frame.write.mode("overwrite").option("compression", "zstd").parquet(beside)
    if files.exists(place):
        files.delete(place, True)
    if not files.rename(part, place):
        raise OSError(f"{beside} was not renamed")


def exclusive(frame: DataFrame, path: str) -> None:
    """CSV that is never written over."""
    frame.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def text_atomic(path: str, text: str) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, beside = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(beside, path)
    except BaseException:
        if os.path.exists(beside):
            os.unlink(beside)
        raise


def json_text(value) -> str:
    """JSON without NaN."""
    return json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n"


def json_atomic(path: str, value) -> None:
    text_atomic(path, json_text(value))


def append_lines(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").json(path)


def formats(prompts: DataFrame, folder: str) -> None:
    """The prompt table as JSON lines, CSV and text."""
    prompts.write.mode("overwrite").json(f"{folder}/jsonl")
    prompts.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    prompts.select("prompt").write.mode("overwrite").text(f"{folder}/txt")


def entries(tiles: DataFrame) -> DataFrame:
    """Compiled entries: x, y, slide id, magnification, level-0 patch size as 32-bit integers."""
    from lamina.operators.index import slide_ids

    names = slide_ids(tiles, "slide_id")
    return tiles.join(names, "slide_id").select(*[F.col(c).cast("int") for c in ("x", "y")], F.col("slide_index").cast("int").alias("slide_id"), F.col("magnification").cast("int").alias("target_magnification"), F.col("patch_size_level0").cast("int"))


def report(title: str, tables: dict[str, tuple[list[str], list[tuple]]]) -> str:
    """An escaped HTML page of small tables."""
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, (columns, rows) in tables.items():
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(cell('th', c) for c in columns)}</tr>")
        parts += [f"<tr>{''.join(cell('td', v) for v in row)}</tr>" for row in rows]
        parts.append("</table>")
    return "\n".join(parts)
