"""String columns: identifiers, templates, placeholders, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def slide_of_file(path: Column) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(basename(path), ".", 1)


def stem(path: Column) -> Column:
    """Base name without its last suffix; a name of only a suffix stays."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def without_patch_suffix(name: Column) -> Column:
    """One trailing _patches or _coords removed."""
    return F.regexp_replace(name, "(_patches|_coords)$", "")


def with_extension(name: Column, extension: str = ".svs", known: tuple[str, ...] = (".svs", ".tif", ".tiff", ".ndpi", ".mrxs")) -> Column:
    return F.when(F.lower(name).rlike("(" + "|".join(x.replace(".", r"\.") for x in known) + ")$"), name).otherwise(F.concat(name, F.lit(extension)))


def cluster_key(magnification: Column, cluster: Column) -> Column:
    return F.format_string("%dx:%d", magnification.cast("int"), cluster.cast("int"))


def concept_id(name: Column) -> Column:
    """Lower case; letters and digits stay, blanks, hyphens, slashes and underscores become one underscore, the rest goes."""
    kept = F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N} \-/_]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[ \-/_]+", "_"), "^_+|_+$", "")


def filled(template: Column, name: Column) -> Column:
    """The template with CLASSNAME or {} replaced, or the name appended."""
    return (
        F.when(F.contains(template, F.lit("CLASSNAME")), F.replace(template, F.lit("CLASSNAME"), name))
        .when(F.contains(template, F.lit("{}")), F.replace(template, F.lit("{}"), name))
        .otherwise(F.concat_ws(" ", template, name))
    )


def prompts(concepts: DataFrame, templates: list[str]) -> DataFrame:
    """polarity, category, concept, concept_id, template_id, prompt: every concept in every template, repeated prompts of a category once (the first template's).

    Templates are a fixed list, so the product is an explode of a literal.
    """
    each = concepts.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(templates)])))
    out = each.select("polarity", "category", "concept", concept_id(F.col("concept")).alias("concept_id"), F.col("t.i").alias("template_id"), filled(F.col("t.t"), F.col("concept")).alias("prompt"))
    out = out.where(F.trim("prompt") != "")
    return out.groupBy("polarity", "category", "prompt").agg(F.min(F.struct("template_id", "concept_id", "concept")).alias("m")).select("polarity", "category", "m.concept", "m.concept_id", "m.template_id", "prompt")


def patch_size_level0(explicit: Column, patch_size: Column, level0: Column, target: Column) -> Column:
    """The recorded size if positive, else patch_size * level0 / target rounded half to even."""
    return F.coalesce(F.when(explicit > 0, explicit), F.bround(patch_size.cast("double") * level0 / target)).cast("int")


def configured(text: Column, values: dict[str, str]) -> Column:
    """Placeholders {{NAME}} replaced by their values."""
    for name, value in values.items():
        text = F.replace(text, F.lit("{{" + name + "}}"), F.lit(value))
    return text


def placeholders_left(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\{\{[A-Z_]+\}\}"))


#: What the redaction looks for by default.
PRIVATE = (r"(?<![\w/])/(?:home|mnt|data|scratch)/[\w./-]+", r"[\w.+-]+@[\w-]+\.[\w.-]*\w", r"\+\d[\d ()-]{8,}\d")


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", patterns: tuple[str, ...] = PRIVATE, prefix: str = "PRIVATE") -> DataFrame:
    """key and text, private values replaced by tokens numbered in the order of the sorted values.

    Values are found by one alternation, longest pattern first; texts are
    rebuilt from the pieces between them, so tokens never overlap. Places belong
    to a text, by its digest, so rows of one key or without one stay apart.
    """
    every = "|".join(f"(?:{p})" for p in sorted(patterns, key=len, reverse=True))
    own = F.sha2(F.col(text), 256)
    found = docs.where(F.col(text).rlike(every)).select(F.col(key).alias("k"), F.col(text).alias("t"), own.alias("d"), F.regexp_extract_all(text, F.lit(f"({every})"), F.lit(1)).alias("v"))
    tokens = redaction_map(found.select(F.explode("v").alias("value")), prefix)
    places = found.select("d", F.posexplode("v").alias("i", "value")).distinct().join(tokens, "value")
    places = places.groupBy("d").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]).alias("tokens"))
    pieces = F.split("t", every, -1)
    new = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("tokens"), i), F.lit("")))), "")
    changed = found.join(places, "d").select("k", new.alias("t"))
    rest = docs.where(~F.coalesce(F.col(text).rlike(every), F.lit(False))).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return changed.unionByName(rest).select(F.col("k").alias(key), F.col("t").alias(text))


def redaction_map(values: DataFrame, prefix: str = "PRIVATE") -> DataFrame:
    """value and token: the mapping that tells what each token stands for, to be kept apart from the texts."""
    return numbered(values.select("value").distinct(), "value", "n").select("value", F.format_string(prefix + "_%04d", F.col("n").cast("long") + 1).alias("token"))


def restored(texts: DataFrame, mapping: DataFrame, text: str = "text", prefix: str = "PRIVATE") -> DataFrame:
    """Texts with their tokens replaced by the values of a kept mapping; unknown tokens stay."""
    every = rf"{prefix}_\d{{4,}}"
    rows = texts.withColumn("_d", F.sha2(F.col(text), 256))
    places = rows.select("_d", F.posexplode(F.regexp_extract_all(text, F.lit(f"({every})"), F.lit(1))).alias("i", "token")).distinct().join(mapping, "token", "left")
    places = places.groupBy("_d").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("value", "token").alias("v")))), lambda x: x["v"]).alias("_v"))
    pieces = F.split(text, every, -1)
    whole = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("_v"), i), F.lit("")))), "")
    return rows.join(places, "_d", "left").withColumn(text, F.when(F.col("_v").isNull(), F.col(text)).otherwise(whole)).drop("_d", "_v")


#: Rows that one task may order by itself.
RANGE_ROWS = 100_000
SAMPLED = 20


def range_of(values: DataFrame, column: str, rows: int = RANGE_ROWS) -> Column:
    """Number of the range that a distinct value lies in, of about `rows` values each; bounds come from a sample by hash, some dozens of values for each range, which the driver holds."""
    n = values.count()
    if n <= rows:
        return F.lit(0)
    step = max(1, rows // SAMPLED)
    held = values.select(column).where(F.pmod(F.xxhash64(column), F.lit(step)) == 0).orderBy(column).collect()
    bounds = [r[0] for r in held[SAMPLED::SAMPLED]]
    if not bounds:
        return F.lit(0)
    table, kind = F.lit(bounds).cast(T.ArrayType(values.schema[column].dataType)), F.col(column)
    steps = F.array(*[F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1)])
    hop = lambda at, s: F.when((at + s <= len(bounds)) & F.coalesce(F.get(table, at + s - 1) <= kind, F.lit(False)), at + s).otherwise(at)
    return F.aggregate(steps, F.lit(0), hop)


def numbered(values: DataFrame, column: str, into: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the position of each row in the order of a distinct column.

    Rows are counted by range; a range's first position is the sum of the counts
    before it, and only rows of one range are ordered together.
    """
    head = values.withColumn("_h", range_of(values, column, rows))
    counts = head.groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(F.col("_h").alias("_h2"), (F.sum("_n").over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    inner = head.withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy(column)) - 1)
    return inner.join(before, F.col("_h") == F.col("_h2")).select(*values.columns, (F.col("_r") + F.col("_before")).cast("long").alias(into))
