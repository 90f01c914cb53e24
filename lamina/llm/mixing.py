"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a keyed shuffle order. A copy's virtual finish
time is the words of its source up to and with it, over the source's target.
All copies are ordered by finish time, and the order is cut where the total
reaches the budget. Running sums are taken in two levels, within a bucket and
over bucket totals, so neither a source nor the whole order has to fit in a
task.

Edge cases: a null text has size 0; a null source is a source of its own, the
last one; sizeless documents are never taken; repeated rows are documents of
their own; an empty table gives an empty result; other columns pass `mix`
unread, under any name and of any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm._session import UNKNOWN, bytes_of, cut, named, unpacked, whole_rows

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Least number of ranges that running sums are taken in; it grows with the table, one more for each RANGE_BYTES.
BUCKETS = 4096
RANGE_BYTES = 32 << 20
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def identity(key: Column, text: Column, source: Column) -> Column:
    """Tells rows apart that differ in id, text or source, nulls included."""
    return F.xxhash64(*[x for c in (key, text, source) for x in (c.isNull(), c.cast("string"))])


def ranges(docs: DataFrame) -> int:
    size = bytes_of(docs)
    return BUCKETS if size >= UNKNOWN else max(BUCKETS, size // RANGE_BYTES)


def sized(docs: DataFrame, id_column: str, text: str, source: str, seed: str, n: int) -> DataFrame:
    """id, source, size, identity h, shuffle key z and its range b of n of every document; written once, as later steps read it often."""
    rows = docs.select(
        named(id_column).alias("doc_id"),
        named(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(named(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        identity(named(id_column), named(text), named(source)).alias("h"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(named(id_column).cast("string"), F.lit(""))).cast("binary")).alias("z"),
    )
    return cut(rows.withColumn("b", F.floor(F.conv(F.substring("z", 1, 8), 16, 10).cast("long") * n / (1 << 32)).cast("int")))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target: `share` of all sizes dealt by weight, no source above `most` times its size.

    Sources fill up in the order of size per weight; what the full ones leave
    is dealt to the rest. One row per source.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), turn % len(weights) + 1))
    by = by.withColumn("r", F.col("source_size") * float(most) / F.col("w"))
    order = Window.orderBy("r", F.asc_nulls_last("source"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    full = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * float(most)
    rest = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    by = by.withColumn("rate", (F.sum("source_size").over(whole) * share - full) / rest)
    rate = F.min_by(F.when(F.col("rate") < F.col("r"), F.col("rate")), F.when(F.col("rate") < F.col("r"), F.col("r"))).over(whole)
    by = by.withColumn("rate", rate)
    return by.select("source", "source_size", F.least(F.col("source_size") * float(most), F.coalesce(F.col("rate") * F.col("w"), F.lit(0.0))).alias("target"))


def running(rows: DataFrame, keys: list[str], bucket: str, order: list[str | Column], size: str, into: str) -> DataFrame:
    """Adds the running sum of size within keys, in the order of bucket, then order."""
    if keys:
        totals = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    else:
        totals = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, bucket).agg(F.sum(size).alias("_t"))
    before = before.select(*[F.col(k).alias(f"_{k}") for k in [*keys, bucket]], F.coalesce(F.sum("_t").over(totals), F.lit(0)).alias("_before"))
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, bucket]]
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_in", F.sum(size).over(inside)).join(before, match)
    return out.withColumn(into, F.col("_in") + F.col("_before")).drop("_in", "_before", *[f"_{k}" for k in [*keys, bucket]])


def schedule(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = SEED,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes the document), finish times and identity h."""
    n = ranges(docs)
    rows = sized(docs, id_column, text, source, seed, n)
    goals = targets(rows, weights, share, most)
    rows = running(rows, ["source"], "b", ["z", "doc_id", "size", "h"], "size", "cum")
    goals = goals.select(F.col("source").alias("_source"), "source_size", "target")
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    finish = [((F.col("cum") + F.col("source_size") * c) / F.col("target")) for c in range(most)]
    able = (F.col("size") > 0) & (F.col("target") > 0)
    rows = cut(rows.select("doc_id", "h", "source", "size", "source_size", "target", F.when(able, F.array(*finish)).alias("finish")))
    copies = rows.select("doc_id", "h", "size", "target", F.posexplode("finish").alias("copy", "f"))
    copies = copies.withColumn("fb", F.floor(F.col("f") * n).cast("long"))
    budget = (rows.agg(F.sum("size")).first()[0] or 0) * share  # one number
    placed = running(copies, [], "fb", ["f", "doc_id", "copy", "h"], "size", "at")
    last = placed.where(F.col("at") <= budget).agg(F.max(F.struct("f", "doc_id", "copy", "h")).alias("last")).first()[0]  # the last copy that is taken
    if last is None:
        count = F.lit(0)
    else:
        cut_at = F.struct(F.lit(last["f"]).alias("f"), F.lit(last["doc_id"]).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.lit(last["copy"]).alias("copy"), F.lit(last["h"]).cast("long").alias("h"))
        count = sum((F.when(F.struct(F.col("finish")[c].alias("f"), F.col("doc_id"), F.lit(c).alias("copy"), F.col("h")) <= cut_at, 1).otherwise(0) for c in range(most)), F.lit(0))
    copies_of = F.when(F.col("finish").isNotNull(), count).otherwise(0).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies_of.alias("copies"), "finish", "h")


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    out = schedule(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, each as often as it is taken, in their columns.

    Rows of equal id, text and source share what is taken of them: of n such
    rows and c copies, c % n come out once more than c // n times.
    """
    key, text, source = (named(options.get(k, v)) for k, v in (("id_column", "doc_id"), ("text", "text"), ("source", "source")))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    plan = schedule(docs, **options).select(name(F.col("doc_id")).alias("id"), "h", "copies")
    plan = plan.groupBy("id", "h").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0")
    out = docs.select(whole_rows(docs), name(key).alias("id"), identity(key, text, source).alias("h")).join(plan, ["id", "h"])
    turn = F.row_number().over(Window.partitionBy("id", "h").orderBy("h"))
    out = out.where("n = 1").withColumn("turn", F.lit(1)).unionByName(out.where("n > 1").withColumn("turn", turn))
    times = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("turn") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    out = out.withColumn("times", times.cast("int")).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return out.select(*unpacked(docs.columns))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS z FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT)] AS w FROM s),
r AS (SELECT *, source_size * {float(MOST)}::DOUBLE / w AS r FROM w),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE}::DOUBLE
        - CAST(coalesce(sum(source_size) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * {float(MOST)}::DOUBLE)
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate FROM r),
g AS (SELECT source, source_size, least(source_size * {float(MOST)}::DOUBLE, coalesce((SELECT min_by(rate, r) FROM l WHERE rate < r) * w, 0)) AS target FROM l),
c AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY z, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
f AS (SELECT *, copy, CAST(cum + source_size * copy AS DOUBLE) / target AS f FROM c, range({MOST}) t(copy) WHERE size > 0 AND target > 0),
a AS (SELECT *, sum(size) OVER (ORDER BY f, doc_id, copy ROWS UNBOUNDED PRECEDING) AS total FROM f),
t AS (SELECT doc_id, source, count(*) AS n FROM a WHERE total <= (SELECT sum(size) FROM d) * {SHARE}::DOUBLE GROUP BY doc_id, source)
SELECT c.doc_id, size, source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken
FROM c LEFT JOIN t ON c.doc_id IS NOT DISTINCT FROM t.doc_id AND c.source IS NOT DISTINCT FROM t.source
"""
