"""Compiled sampling index and deterministic hierarchical draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import rng
from lamina.functions.documents import BUCKET_BITS
from lamina.session import cut

CELL = ["magnification", "coarse_cluster_id", "fine_cluster_id"]


def slide_ids(slides: DataFrame, column: str) -> DataFrame:
    """Dense ids in the order of the distinct values. Slides are a dimension, orders of magnitude fewer than tiles; prefixes are numbered apart."""
    from lamina.functions.text import numbered

    return numbered(slides.select(column).distinct(), column, "slide_index")


def groups(tiles: DataFrame) -> DataFrame:
    """Tiles of each (magnification, coarse, fine, slide)."""
    return tiles.groupBy(*CELL, "slide_id").agg(F.count(F.lit(1)).alias("n_entries"))


def offsets(rows: DataFrame, order: list[str], size: str, start: str, end: str, within: list[str]) -> DataFrame:
    """Half-open ranges of a running total in the order of (within, order), by group totals and sums inside groups."""
    totals = rows.groupBy(*within).agg(F.sum(size).alias("_t"))
    before = totals.select(*[F.col(c).alias(f"_{c}") for c in within], (F.sum("_t").over(Window.orderBy(*within).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).alias("_b"))
    inner = F.sum(size).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn(end, inner).join(before, [F.col(c) == F.col(f"_{c}") for c in within])
    return out.withColumn(end, F.col(end) + F.col("_b")).withColumn(start, F.col(end) - F.col(size)).drop("_b", *[f"_{c}" for c in within])


def slide_groups(tiles: DataFrame) -> DataFrame:
    """Slide groups with their entry ranges, by cell and slide."""
    return offsets(groups(tiles), ["slide_id"], "n_entries", "entry_start", "entry_end", CELL)


def fine_records(tiles: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Fine cells with the ranges of their slide groups, and the bucket mask (1: random only)."""
    cells = groups(tiles).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_slides"), F.sum("n_entries").alias("n_entries"))
    out = offsets(cells, CELL[1:], "n_slides", "slide_start", "slide_end", ["magnification"])
    if masks is not None:
        return out.join(F.broadcast(masks.select("magnification", "fine_cluster_id", "bucket_mask")), ["magnification", "fine_cluster_id"])
    return out.withColumn("bucket_mask", F.lit(1))


def violations(records: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: broken rules of a compiled index; all 0 for a sound one."""
    a = records.agg(F.count_if(F.col("slide_end") <= F.col("slide_start")).alias("empty_cells"), F.count_if(F.col("bucket_mask").bitwiseAND(F.lit(1)) == 0).alias("not_random"), (F.count(F.lit(1)) - F.count_distinct(*CELL)).alias("repeated_cells"))
    b = entries.agg(F.count_if(F.col("entry_end") <= F.col("entry_start")).alias("empty_groups"), (F.sum("n_entries") - F.max("entry_end")).alias("uncovered_entries"))
    return a.crossJoin(b)


def draws(spark, tiles: DataFrame, records: DataFrame, n: int, magnifications: dict[int, float], buckets: dict[str, float], seed: int = 7, start: int = 0) -> DataFrame:
    """n draws with replacement, each a pure function of (seed, draw): magnification and bucket by weight, then coarse cell, fine cell, slide and tile uniformly.

    Every level is a table with an ordinal, so a draw is a chain of equi-joins;
    only those to cells, whose number is configured, are broadcast.
    """
    draw = F.col("draw")
    rows = spark.range(start, start + n).withColumnRenamed("id", "draw")
    rows = rows.withColumn("magnification", rng.choice(rng.random_unit(seed, draw, 0), magnifications)).withColumn("bucket", rng.choice(rng.random_unit(seed, draw, 1), buckets))
    bits = F.create_map(*[F.lit(x) for k, b in BUCKET_BITS.items() for x in (k, b)])
    names = F.array(*[F.lit(k) for k in buckets])
    cells = records.withColumn("bucket", F.explode(names)).where(F.getbit("bucket_mask", F.element_at(bits, F.col("bucket"))) == 1)
    fine = F.row_number().over(Window.partitionBy("magnification", "bucket", "coarse_cluster_id").orderBy("fine_cluster_id")) - 1
    cells = cells.select("magnification", "bucket", "coarse_cluster_id", "fine_cluster_id", "n_slides", fine.alias("fine_at"))
    coarse = cells.groupBy("magnification", "bucket", "coarse_cluster_id").agg(F.count(F.lit(1)).alias("n_fine"))
    at = Window.partitionBy("magnification", "bucket")
    coarse = coarse.withColumn("coarse_at", F.row_number().over(at.orderBy("coarse_cluster_id")) - 1).withColumn("n_coarse", F.count(F.lit(1)).over(at))
    counts = coarse.select("magnification", "bucket", "n_coarse").distinct()
    rows = rows.join(F.broadcast(counts), ["magnification", "bucket"]).withColumn("coarse_at", rng.random_index(seed, draw, 2, F.col("n_coarse")))
    rows = rows.join(F.broadcast(coarse.drop("n_coarse")), ["magnification", "bucket", "coarse_at"]).withColumn("fine_at", rng.random_index(seed, draw, 3, F.col("n_fine")))
    rows = rows.join(F.broadcast(cells), ["magnification", "bucket", "coarse_cluster_id", "fine_at"]).withColumn("slide_at", rng.random_index(seed, draw, 4, F.col("n_slides")))
    slides = cut(groups(tiles)).withColumn("slide_at", F.row_number().over(Window.partitionBy(*CELL).orderBy("slide_id")) - 1)
    rows = rows.join(slides, [*CELL, "slide_at"]).withColumn("tile_at", rng.random_index(seed, draw, 5, F.col("n_entries")))
    rows = cut(rows)
    drawn = rows.select(*CELL, "slide_id").distinct()  # at most n groups; only their tiles are numbered
    entries = tiles.select(*CELL, "slide_id", "packed_row_index").join(drawn, [*CELL, "slide_id"], "left_semi").withColumn("tile_at", F.row_number().over(Window.partitionBy(*CELL, "slide_id").orderBy("packed_row_index")) - 1)
    return rows.join(entries.select(*CELL, "slide_id", "tile_at", "packed_row_index"), [*CELL, "slide_id", "tile_at"]).select("draw", "magnification", "bucket", "coarse_cluster_id", "fine_cluster_id", "slide_id", "packed_row_index")


def strided(rows: DataFrame, ordinal: str, rank: int, world: int) -> DataFrame:
    """Every world-th row, from rank on."""
    return rows.where(F.pmod(F.col(ordinal), F.lit(world)) == rank)


def sample_per_group(rows: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group by keyed hash order: reproducible on any layout."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order, key))).where(F.col("_r") <= n).drop("_r")


def split(rows: DataFrame, key: str, share: float = 0.9, seed: int = 0) -> DataFrame:
    """Adds is_train: true for about `share` of the keys, by hash."""
    number = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("is_train", number < share)


#: Options that each kind of sampler takes.
SAMPLERS = {"sequential": {"rank", "world"}, "epoch": {"seed", "epoch", "size", "rank", "world"}, "infinite": {"seed", "start", "n"}, "hierarchical": {"records", "n", "magnifications", "buckets", "seed", "start"}}


def sampler(kind: str, rows: DataFrame, ordinal: str, **options) -> DataFrame:
    """Rows in the order of a sampler; options that the kind does not take are refused.

    sequential: every world-th row. epoch: the rows laid end to end until there
    are `size` of them, in an order that is keyed by seed * epoch (by the epoch
    itself if the seed is 0), of which a rank takes every world-th one; `place`
    is the position in that order. infinite: draws with replacement from
    `start` on, each a function of its number. hierarchical: draws() over the
    tiles in `rows` and the compiled `records`.
    """
    if kind not in SAMPLERS or not set(options) <= SAMPLERS[kind]:
        raise ValueError(f"{kind} sampler does not take {sorted(set(options) - SAMPLERS.get(kind, set()))}")
    rank, world = options.get("rank", 0), options.get("world", 1)
    if kind == "sequential":
        return strided(rows, ordinal, rank, world).orderBy(ordinal)
    if kind == "epoch":
        from lamina.functions.text import numbered

        seed, epoch = options.get("seed", 0), options.get("epoch", 0)
        n = rows.count()
        size = options.get("size", n)
        if not n or not size:
            return rows.limit(0).withColumn("place", F.lit(0).cast("long"))
        keyed = lambda turn: F.xxhash64(F.col(ordinal), turn, F.lit(seed * epoch if seed else epoch))
        tiled = rows.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(-(-size // n) - 1))))
        order = F.concat_ws(":", F.lpad(F.hex(keyed(F.col("_turn"))), 16, "0"), F.lpad(F.col("_turn").cast("string"), 10, "0"), F.col(ordinal).cast("string"))
        if size % n:  # the last turn takes only the first rows, by their ordinal
            tiled = numbered(rows.select(ordinal), ordinal, "_at").join(tiled, ordinal).where(F.col("_turn") * n + F.col("_at") < size).drop("_at")
        placed = numbered(tiled.withColumn("_k", order), "_k", "place")
        return placed.where(F.pmod(F.col("place"), F.lit(world)) == rank).drop("_k", "_turn").orderBy("place")
    if kind == "hierarchical":
        spark = rows.sparkSession
        return draws(spark, rows, options["records"], options["n"], options["magnifications"], options["buckets"], options.get("seed", 7), options.get("start", 0))
    if kind == "infinite":
        total = rows.agg(F.count(F.lit(1)).alias("_n"))  # one row
        drawn = rows.sparkSession.range(options.get("start", 0), options.get("start", 0) + options["n"]).withColumnRenamed("id", "draw")
        drawn = drawn.crossJoin(F.broadcast(total)).withColumn(ordinal, rng.random_index(options.get("seed", 0), F.col("draw"), 0, F.col("_n"))).drop("_n")
        return drawn.join(rows, ordinal)
    raise ValueError(kind)


def entries_of(rows: DataFrame) -> DataFrame:
    """Tile entries of either stored version: with a level (patch sizes double with each) or with a level-0 patch size."""
    if "patch_size_level0" in rows.columns:
        return rows.select("x", "y", "slide_id", "patch_size_level0")
    return rows.select("x", "y", "slide_id", (F.lit(256) * F.pow(F.lit(2), F.col("level"))).cast("int").alias("patch_size_level0"))
