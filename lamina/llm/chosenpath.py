"""Jaccard join of word-shingle sets by chosen paths, and near-duplicate classes.

Sets of equal content become one node first, so copies are never paired. A node
is embedded into `BINS` tokens (the least shingle of each hash range). In each
run a node descends along tokens that an order of its path selects, so two nodes
descend along shared tokens with a chance of their similarity; runs are repeated
until the target recall. A bucket (a path) is
compared with its hub first: nodes near the hub join its family, and those so
near that all their partners must be near the hub too (Jaccard distance is a
metric) need no further comparison. What is left of a small bucket is compared
pair by pair, what is left of a large one descends further.

Families, the components of likely links, then get an exact check: every pair
of nodes in a family is compared on whole shingle sets, in blocks, so a family
of any size is split over tasks. Links are counted, not emitted.

Edge cases: a document of one to four words has one shingle, all its words; a
null text or one without words has no shingle, no link and a class of its own;
repeated rows are copies; a null id counts as the greatest; an empty table gives
an empty result; other columns of the table are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import _arrow as A
from lamina.llm._repeats import LAST, windows_inside
from lamina.llm._session import arrow_map, cut, named, partitions, unpacked, whole_rows

WORDS = 5
BINS = 128
RECALL = 0.9999
CHILDREN = 2  # tokens that a node chooses below a path whose bucket descends
SMALL = 1024
DEPTH = 4
NEAR = 0.4  # estimates at or above join a family
DEEP = 0.8  # a node this near its hub has no link to one that is not near it: Jaccard distance is a metric, and 0.1 is left for errors of estimates
BLOCK = 1024


def runs_for(recall: float, similarity: float) -> int:
    """Runs until a link at this similarity is met with this chance, even if all its buckets descend to the last level.

    A pair chooses the same token with a chance of its similarity: once a run,
    and CHILDREN times below each path that it shares.
    """
    lost = 0.0
    for _ in range(DEPTH - 1):
        lost = (1 - similarity * (1 - lost)) ** CHILDREN
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity * (1 - lost))))


def orders(runs: int) -> list[np.ndarray]:
    """For each run an order of the bins; the first bins of the runs differ."""
    keys = A.mix(np.arange((runs + 1) * BINS, dtype=np.uint64) + A.U(0xC0FFEE)).reshape(runs + 1, BINS)
    first, out = np.argsort(keys[-1]), []
    for run in range(runs):
        rest = np.argsort(keys[run])
        out.append(np.r_[first[run % BINS], rest[rest != first[run % BINS]]])
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = WORDS):
    """Distinct shingles of each row in ascending order, and the rows' offsets among them."""
    starts, ends, row = A.words(data, offsets)
    h = A.span_hashes(data, starts, ends)
    by = np.searchsorted(row, np.arange(len(offsets)))
    at = np.flatnonzero(windows_inside(by, len(h), n))
    values, rows = [A.roll(h, n)[at]], [row[at]]
    size = np.diff(by)
    for few in range(1, n):
        short = np.flatnonzero(size == few)
        if len(short):
            values.append(A.mix(A.roll(h, few)[by[short]] + A.U(few)))
            rows.append(short)
    value, row = np.concatenate(values), np.concatenate(rows)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[fresh], row[fresh]
    return value, np.searchsorted(row, np.arange(len(offsets)))


def sums(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[by[1:]] - total[by[:-1]]


def embedded(runs: int):
    """k, h, node digest x, n shingles, sketch and first paths of each document that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from one(batch)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = A.buffer(A.rows(batch, "text"))
        for i, j in A.slices(offsets):
            value, by = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            some = np.flatnonzero(np.diff(by))
            if not len(some):
                continue
            row = np.repeat(np.arange(j - i), np.diff(by))
            x = np.stack([A.mix(sums(A.mix(value), by)), A.mix(sums(A.mix(value ^ A.U(0xA5A5A5A5A5A5A5A5)), by))], 1)[some]
            bins = (value >> A.U(57)).astype(np.int64)
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bins[1:] != bins[:-1])])
            sketch = np.zeros((j - i, BINS), np.uint8)
            sketch[row[first], bins[first]] = 1 + (value[first] & A.U(0xFF)) % A.U(255)
            held = np.zeros((j - i, BINS), np.int64)  # where the value of a bin is
            held[row[first], bins[first]] = first
            paths, lines = [], np.arange(j - i)
            for run, order in enumerate(orders(runs)):
                bin_ = order[np.argmax(sketch[:, order] > 0, 1)]  # the first bin that is not empty
                paths.append(A.mix(value[held[lines, bin_]] ^ A.mix(np.array([run + 1], np.uint64)))[some])
            path = np.stack(paths, 1).view(np.int64).ravel()
            cuts = (np.arange(len(some) + 1) * runs).astype(np.int32)
            binary = lambda m: pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer((np.arange(len(m) + 1) * m.shape[1] * m.itemsize).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(m).tobytes())])
            keep = pa.array(some + i)
            yield pa.RecordBatch.from_arrays(
                [A.rows(batch, "k").take(keep), A.rows(batch, "h").take(keep), binary(x), pa.array(np.diff(by)[some].astype(np.int64)), binary(sketch[some]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(path))],
                names=["k", "h", "x", "n", "sketch", "paths"],
            )

    return run


def matrix(column: pa.Array) -> np.ndarray:
    data, _ = A.buffer(column)
    return data.reshape(len(column), -1)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches, along the last axis."""
    same = np.count_nonzero((a == b) & (a > 0), -1)
    return same / np.maximum(1, np.count_nonzero((a > 0) | (b > 0), -1))


def against_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds how near a node is to the hub of its bucket."""
    for batch in batches:
        if batch.num_rows:
            near = alike(matrix(A.rows(batch, "sketch")), matrix(A.rows(batch, "hub_sketch")))
            yield pa.RecordBatch.from_arrays([A.rows(batch, c) for c in ("path", "size", "x", "sketch", "hub")] + [pa.array(near)], names=["path", "size", "x", "sketch", "hub", "near"])


def descend(level: int):
    """Next paths of the nodes of large buckets: each path orders the bins in its own way, and a node chooses the tokens of the first ones that it fills."""
    bins = A.mix(np.arange(BINS, dtype=np.uint64) + A.U(level << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sketch = matrix(A.rows(part, "sketch"))
                path = np.asarray(A.rows(part, "path")).view(np.uint64)
                order = A.mix(path[:, None] ^ bins[None, :])
                order[sketch == 0] = A.U((1 << 64) - 1)
                col = np.argpartition(order, range(CHILDREN), 1)[:, :CHILDREN].ravel()
                row = np.repeat(np.arange(len(path)), CHILDREN)
                some = sketch[row, col] > 0
                row, col = row[some], col[some]
                token = sketch[row, col].astype(np.uint64) + (col.astype(np.uint64) << A.U(8)) + A.U(level << 20)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(A.mix(path[row] ^ A.mix(token)).view(np.int64)), A.rows(part, "x").take(take), A.rows(part, "sketch").take(take)], names=["path", "x", "sketch"])

    return run


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows that share keys, from a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    mine = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in keys]
        marks = list(zip(*columns, strict=True))
        at = 0
        for i, mark in enumerate(marks):
            if mark != mine:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, mine = [], i, mark
        if len(marks) > at:
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def by_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likely links of the nodes that are far from the hub, to each other and to near ones. Near nodes are one component already; the others are tied to the first node of theirs."""
    for table in runs_of(batches, ["path", "kind", "b1", "b2"]):
        n = table.num_rows
        known = np.asarray(table.column("near")) >= NEAR
        if n < 2 or known.all():
            continue
        sketch = matrix(table.column("sketch").combine_chunks())
        tied = np.flatnonzero(known)
        a, b = [tied[1:]], [tied[:-1]]
        for i in np.flatnonzero(~known):
            hit = np.flatnonzero(alike(sketch, sketch[i][None, :]) >= NEAR)
            a.append(np.full(len(hit), i))
            b.append(hit)
        root = roots(n, np.concatenate(a), np.concatenate(b))
        x = table.column("x").combine_chunks()
        moved = np.flatnonzero((root != np.arange(n)) & ~(known & known[root]))
        if len(moved):
            yield pa.RecordBatch.from_arrays([x.take(pa.array(moved)), x.take(pa.array(root[moved]))], names=["u", "v"])


def dealt_sides(rows: DataFrame, block: int) -> DataFrame:
    """Deals the rows of a bucket (n_near, n_far) to groups (kind, b1, b2) in which every far row meets every other row; near rows need not meet. A bucket within `block` is one group."""
    whole = F.col("n_near") + F.col("n_far") <= block
    near, far = (F.greatest(F.ceil(F.col(c) / block), F.lit(1)).cast("int") for c in ("n_near", "n_far"))
    mine = lambda n: F.pmod(F.xxhash64("x", F.lit(77)), n).cast("int")
    key = lambda kind, b1, b2: F.struct(F.lit(kind).alias("kind"), b1.alias("b1"), b2.alias("b2"))
    to_far = F.transform(F.sequence(F.lit(0), far - 1), lambda j: key(0, mine(near), j))
    to_near = F.when(F.col("n_near") > 0, F.transform(F.sequence(F.lit(0), near - 1), lambda i: key(0, i, mine(far)))).otherwise(F.array().cast("array<struct<kind:int,b1:int,b2:int>>"))
    among = F.transform(F.sequence(F.lit(0), far - 1), lambda j: key(1, F.least(mine(far), j), F.greatest(mine(far), j)))
    keys = F.when(whole, F.array(key(1, F.lit(0), F.lit(0)))).when(F.col("near") >= NEAR, to_far).otherwise(F.concat(to_near, among))
    return rows.withColumn("g", F.explode(keys)).select("path", "g.*", "x", "sketch", "near")


def blocks(frame: DataFrame, size: str, block: int, key: str) -> DataFrame:
    """Deals each group's rows to pairs of blocks (b1, b2): every two rows of a group meet in one, and a group within `block` is one."""
    count = F.ceil(F.col(size) / block).cast("int")
    mine = F.pmod(F.xxhash64(key, F.lit(77)), count).cast("int")
    frame = frame.withColumn("b0", mine).withColumn("b", F.explode(F.sequence(F.lit(0), count - 1)))
    return frame.withColumn("b1", F.least("b0", "b")).withColumn("b2", F.greatest("b0", "b")).drop("b")


def apart(frame: DataFrame, key: str, *aggregates) -> DataFrame:
    """groupBy(key).agg(...), its rows dealt by another expression than the key's: a join on the key then deals both sides anew, so that adaptive execution can split a hot key of the other side."""
    out = frame.groupBy(F.struct(key).alias("apart")).agg(*aggregates)
    return out.withColumn(key, F.col(f"apart.{key}")).drop("apart")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the edges (u, v), by large-star and small-star steps."""
    edges = cut(edges.where("u != v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = apart(both, "u", F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        # all edges are stars once a node has one edge up, or is one that edges lead to, not both
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def likely(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) whose components hold every link, but for the target recall."""
    n = partitions(nodes.sparkSession)
    rows = nodes.select(F.explode("paths").alias("path"), "x", "sketch")
    edges = None
    for level in range(2, DEPTH + 2):
        hubs = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("x", "sketch")).alias("hub")).where("size > 1")
        hubs = hubs.select("path", "size", F.col("hub.x").alias("hub"), F.col("hub.sketch").alias("hub_sketch"))
        kind = "path long, size long, x binary, sketch binary, hub binary, near double"
        seen = cut(arrow_map(rows.join(hubs, "path").where("x != hub"), against_hub, kind))
        found = seen.where(F.col("near") >= NEAR).select(F.col("x").alias("u"), F.col("hub").alias("v")).distinct()
        # where every node is near the hub, all are of one family
        left = seen.where(F.col("near") < DEEP)
        sides = left.groupBy("path").agg(F.count_if(F.col("near") >= NEAR).alias("n_near"), F.count_if(F.col("near") < NEAR).alias("n_far")).where("n_far > 0 and n_near + n_far > 1")
        left = cut(left.select("path", "x", "sketch", "near").join(sides, "path"))
        here = (F.col("n_far") <= SMALL) if level <= DEPTH else F.lit(True)
        small = dealt_sides(left.where(here), SMALL).repartition(n, "path", "kind", "b1", "b2").sortWithinPartitions("path", "kind", "b1", "b2")
        found = found.unionByName(arrow_map(small, by_pairs, "u binary, v binary"))
        edges = found if edges is None else edges.unionByName(found)
        large = left.where(~here)
        if level > DEPTH or large.isEmpty():
            break
        rows = arrow_map(large, descend(level), "path long, x binary, sketch binary")
    return edges


def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the text by its shingles, packed."""
    for batch in batches:
        data, offsets = A.buffer(A.rows(batch, "text"))
        names = [c for c in batch.schema.names if c != "text"]
        for i, j in A.slices(offsets):
            value, by = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((by * 8).astype(np.int32).tobytes()), pa.py_buffer(value.tobytes())])
            yield pa.RecordBatch.from_arrays([*[A.rows(batch, c).slice(i, j - i) for c in names], packed], names=[*names, "members"])


def verified(part: int, whole: int):
    """Exact links of each node in its group of blocks: how many documents it is linked to, and its component's first node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, ["family", "b1", "b2"]):
            n = table.num_rows
            data, offsets = A.buffer(table.column("members").combine_chunks())
            value, by = np.frombuffer(data.tobytes(), np.uint64), offsets // 8
            copies, home = np.asarray(table.column("copies")), np.asarray(table.column("b0"))
            b1, b2 = table.column("b1")[0].as_py(), table.column("b2")[0].as_py()
            row = np.repeat(np.arange(n), np.diff(by))
            order = np.argsort(value, kind="stable")
            group = np.cumsum(np.r_[False, value[order][1:] != value[order][:-1]])
            shared = (np.bincount(group) > 1)[group]
            column, member = group[shared], row[order][shared]
            _, column = np.unique(column, return_inverse=True)
            common = np.zeros((n, n), np.int64)
            for low in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
                a, b = np.searchsorted(column, [low, low + 4096])
                some, place = np.unique(member[a:b], return_inverse=True)
                block = np.zeros((len(some), int(column[b - 1]) - low + 1), np.float32)
                block[place, column[a:b] - low] = 1
                common[np.ix_(some, some)] += (block @ block.T).astype(np.int64)  # at most 4,096 a block, exact in float32
            size = np.diff(by)
            linked = common * (part + whole) >= whole_sum(size, whole, part)
            np.fill_diagonal(linked, False)
            pairs = linked.copy()
            if b1 != b2:  # pairs inside one block are counted where both blocks are that one
                linked &= home[:, None] != home[None, :]
            links = (linked * copies[None, :]).sum(1)
            root = roots(n, *np.nonzero(np.triu(pairs)))
            x = table.column("x").combine_chunks()
            yield pa.RecordBatch.from_arrays([x, pa.array(links.astype(np.int64)), x.take(pa.array(root))], names=["x", "links", "root"])

    return run


def whole_sum(size: np.ndarray, whole: int, part: int) -> np.ndarray:
    """common / (a + b - common) >= whole / part, as common * (part + whole) >= whole * (a + b)."""
    return whole * (size[:, None] + size[None, :])


def join(docs: DataFrame, part: int = 5, whole: int = 4, recall: float = RECALL, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """k, h (id and text hash), root (its class; null without words), class_id and n_links of every document, for a similarity of whole / part or more; runs are repeated until links at that similarity are met with a chance of `recall`."""
    n = partitions(docs.sparkSession)
    body = F.coalesce(named(text).cast("string"), F.lit(""))
    base = docs.select(F.coalesce(named(id_column).cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(body).alias("h"), body.alias("text"))
    seen = cut(arrow_map(base, embedded(runs_for(recall, whole / part)), "k long, h long, x binary, n long, sketch binary, paths array<long>"))
    nodes = seen.groupBy("x").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("k", "h", "sketch", "paths")).alias("d")).select("x", "copies", F.col("d.k").alias("k"), F.col("d.h").alias("h"), "d.sketch", "d.paths")
    nodes = cut(nodes)
    families = components(likely(nodes)).withColumnRenamed("node", "x").withColumnRenamed("root", "family")
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    asked = families.join(sizes, "family").join(nodes.select("x", "copies", "k", "h"), "x").dropDuplicates(["x"])
    sets = base.join(asked, ["k", "h"]).select("family", "size", "x", "copies", "text")
    sets = arrow_map(sets, with_sets, "family binary, size long, x binary, copies long, members binary")
    dealt = blocks(sets, "size", BLOCK, "x").repartition(n, "family", "b1", "b2").sortWithinPartitions("family", "b1", "b2")
    exact = cut(arrow_map(dealt, verified(part, whole), "x binary, links long, root binary"))
    links = exact.groupBy("x").agg(F.sum("links").alias("links"))
    classes = components(exact.select(F.col("x").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "x")
    of = nodes.select("x", "copies").join(links, "x", "left").join(classes, "x", "left")
    of = of.select("x", F.coalesce("root", "x").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    members = seen.select("k", "h", "x").join(of, "x")
    first = members.groupBy("root").agg(F.min("k").alias("class_id"))
    members = members.join(first, "root").select("k", "h", "root", "class_id", "n_links")
    bare = base.where(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("k", "h", F.lit(None).cast("binary").alias("root"), F.col("k").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return members.unionByName(bare)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and n_links."""
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return join(docs).select(known("k").alias("doc_id"), known("class_id").alias("class_id"), "n_links")


def representatives(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with one document of each class: the one of least id, and of its rows that of least text hash."""
    found = join(docs, id_column=id_column, text=text)
    kept = found.where("root is not null").groupBy("root").agg(F.min(F.struct("k", "h")).alias("one"))
    bare = F.lit(r"[^\x20\x09-\x0D]")
    body = F.coalesce(named(text).cast("string"), F.lit(""))
    rows = docs.select(whole_rows(docs), F.coalesce(named(id_column).cast("long"), F.lit(LAST)).alias("k"), F.xxhash64(body).alias("h"), F.regexp_like(body, bare).alias("some"))
    out = rows.where("some").join(kept.select("one.k", "one.h"), ["k", "h"], "left_semi").dropDuplicates(["k", "h"])
    return out.unionByName(rows.where(~F.col("some"))).select(*unpacked(docs.columns))
