"""File inventories, shards, metadata, manifests, prompts and dataset references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import text as X


class SourceError(ValueError):
    """A source that breaks a rule; the message names the first offenders."""


def guard(frame: DataFrame, what: str, show: int = 5) -> None:
    """Raises if the frame has rows; a few of them are named."""
    found = [r.asDict() for r in frame.limit(show).collect()]
    if found:
        raise SourceError(f"{what}: {found}")


def listing(spark: SparkSession, folder: str, pattern: str = "*.h5") -> DataFrame:
    """path, size and time of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def discovered(spark: SparkSession, folders: list[str], pattern: str = "*.h5", required: bool = True) -> DataFrame:
    """path and slide_id of distinct files in path order; an id that two files share is an error."""
    out = None
    for folder in folders:
        part = listing(spark, folder, pattern)
        out = part if out is None else out.unionByName(part)
    out = out.dropDuplicates(["path"]).withColumn("slide_id", X.without_patch_suffix(X.stem(F.col("path"))))
    if required and out.isEmpty():
        raise SourceError(f"no {pattern} in {folders}")
    guard(out.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "slides with several files")
    return out.orderBy("path")


def attributes(root: Column, coords: Column, features: Column) -> Column:
    """The attribute that was written last."""
    return F.coalesce(features, coords, root)


def upsampled(target: Column, level0: Column) -> Column:
    """Whether a shard is magnified beyond its scan; an unknown scan (0 or less) is not."""
    return F.coalesce((level0 > 0) & (target > level0), F.lit(False))


def shards(inspected: DataFrame, exclude_upsampled: bool = True) -> tuple[DataFrame, DataFrame]:
    """Kept and excluded shards. inspected: mag, path, slide_id, n_tiles, feature_dim, target_magnification, level0_magnification."""
    over = upsampled(F.col("target_magnification"), F.col("level0_magnification"))
    rows = inspected.where(F.col("n_tiles") > 0)
    if not exclude_upsampled:
        return rows, rows.limit(0).withColumn("reason", F.lit(None).cast("string"))
    return rows.where(~over), rows.where(over).withColumn("reason", F.lit("target_above_scan"))


def checked_shards(kept: DataFrame) -> DataFrame:
    """Shards with row_start, their running row count in path order; one feature size and no slide twice in a magnification."""
    guard(kept.groupBy("mag").agg(F.count_distinct("feature_dim").alias("sizes")).where("sizes > 1"), "feature sizes differ")
    guard(kept.groupBy("mag", "slide_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "slides occur twice")
    return with_row_start(kept)


def with_row_start(kept: DataFrame, order: str = "path") -> DataFrame:
    w = Window.partitionBy("mag").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("row_start", F.sum("n_tiles").over(w) - F.col("n_tiles"))


def gaps(index: DataFrame) -> DataFrame:
    """Shards whose row_start is not the sum of the rows before."""
    w = Window.partitionBy("mag").orderBy("row_start")
    due = F.coalesce(F.lag(F.col("row_start") + F.col("n_tiles")).over(w), F.lit(0))
    return index.withColumn("due", due).where(F.col("due") != F.col("row_start"))


def slide_metadata(records: DataFrame) -> DataFrame:
    """One row for each key that a record goes by: its submitter id and its file's slide id; a key of two records is an error."""
    keys = F.array_distinct(F.array(F.col("slide_submitter_id"), X.slide_of_file(F.col("file_name"))))
    out = records.withColumn("slide_id", F.explode(F.filter(keys, lambda k: k.isNotNull() & (k != ""))))
    return out


def clashing_keys(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("slide_id").agg(F.count_distinct(F.coalesce("file_id", F.lit(""))).alias("n")).where("n > 1")


def wsi_manifest(spark: SparkSession, path: str) -> DataFrame:
    """wsi_key, wsi_path from CSV or Parquet by suffix; the first column that has text counts; relative paths are taken from the manifest's folder."""
    rows = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
    first = lambda names: F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns], F.lit(None).cast("string"))
    here = path.rsplit("/", 1)[0] if "/" in path else "."
    where = first(["wsi_path", "path"])
    out = rows.select(first(["wsi_id", "file_name", "slide_id"]).alias("wsi_key"), F.when(where.rlike(r"^(/|\w+:)"), where).otherwise(F.concat(F.lit(here + "/"), where)).alias("wsi_path"))
    guard(out.groupBy("wsi_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or wsi_key is null"), "manifest keys")
    return out


def resolved_wsi(slides: DataFrame, manifest: DataFrame, template: str, keys: tuple[str, ...] = ("file_name", "wsi_id", "slide_id", "slide_submitter_id")) -> DataFrame:
    """Adds wsi_path: the manifest's entry of the first key that has one, else the template with its {field}s filled."""
    out, found = slides, []
    for i, key in enumerate(k for k in keys if k in slides.columns):
        out = out.join(manifest.select(F.col("wsi_key").alias(f"_k{i}"), F.col("wsi_path").alias(f"_p{i}")), F.col(key) == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_p{i}"))
    import re

    made = F.lit(template)
    for field in re.findall(r"{(\w+)}", template):
        if field not in slides.columns:
            raise SourceError(f"template field {field}")
        made = F.replace(made, F.lit("{" + field + "}"), F.col(field).cast("string"))
    return out.select(*slides.columns, F.coalesce(*found, made).alias("wsi_path"))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """prompt_id, prompt from JSON lines, JSON, CSV or text by suffix; blank prompts go, in text files also lines that begin with #."""
    if path.endswith((".jsonl", ".ndjson")):
        rows = spark.read.json(path)
    elif path.endswith(".json"):
        rows = spark.read.option("multiLine", True).json(path)
    elif path.endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
    else:
        rows = spark.read.text(path).withColumnRenamed("value", "prompt").where(~F.ltrim("prompt").startswith("#"))
    return named_prompts(rows)


def named_prompts(rows: DataFrame) -> DataFrame:
    texts = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("prompt", "text") if c in rows.columns]
    names = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("prompt_id", "id") if c in rows.columns]
    out = rows.withColumn("_t", F.coalesce(*texts, F.lit(None).cast("string")))
    made = F.concat(F.lit("prompt_"), F.substring(F.md5(F.col("_t").cast("binary")), 1, 12))
    return out.where(F.col("_t").isNotNull()).select(F.coalesce(*names, made).alias("prompt_id"), F.col("_t").alias("prompt"))


def dataset_reference(text: str) -> tuple[str, dict[str, str]]:
    """Name and options of Name:key=value:key=value."""
    name, *options = text.split(":")
    out: dict[str, str] = {}
    for item in options:
        key, sep, value = item.partition("=")
        if key not in ("root", "extra", "split") or not sep:
            raise SourceError(f"dataset option {item!r}")
        out[key] = value
    return name, out


def image_entries(files: DataFrame, labels: DataFrame) -> DataFrame:
    """actual_index, class_id, class_index, class_name of image files named <class>/<class>_<index>.<suffix>. labels: class_id, class_name (a table of classes)."""
    rows = files.select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("class_id"), F.regexp_extract("path", r"_(\d+)\.\w+$", 1).cast("long").alias("actual_index"))
    classes = labels.select("class_id", "class_name").withColumn("class_index", F.row_number().over(Window.orderBy("class_id")) - 1)
    return rows.join(F.broadcast(classes), "class_id", "left")


def hdf5_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """slide_id, row_idx, x, y, embedding of feature shards; needs h5py on the executors. One task reads one file, in chunks."""

    def read(batches):
        import h5py
        import pandas as pd

        for batch in batches:
            for path in batch["path"]:
                with h5py.File(path, "r") as f:
                    x, c = f["features"], f["coords"]
                    for i in range(0, len(x), 8192):
                        part = x[i : i + 8192]
                        yield pd.DataFrame({"path": path, "row_idx": range(i, i + len(part)), "x": c[i : i + 8192, 0], "y": c[i : i + 8192, 1], "embedding": list(part)})

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    rows = files.mapInPandas(read, "path string, row_idx long, x long, y long, embedding array<float>")
    return rows.withColumn("slide_id", X.without_patch_suffix(X.stem(F.col("path")))).drop("path")
