"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary texts, each with
interpolated Kneser-Ney smoothing. A bigram backs off to its word, a word to its
stem (its first 6 characters), that to its first 4 characters, and these to
counts over the whole corpus, which both classes share: so a rare form of a
known stem is scored by the stem, and an expression that neither class has seen
says next to nothing. Every level takes continuation counts (in how many
distinct longer expressions it stands) and a discount from the counts of
counts; the weight that a history leaves to its backoff enters the score of
bigrams that were never seen.

A text's evidence is the difference of its two log-likelihoods over its words
(length-normalised), and the differences of its most toxic words (by rank,
RANKS), which long texts do not dilute. A logistic curve, fitted on labelled
rows that the models have not seen, makes it a score. In the fit a class weighs
as the square root of its rows, so the cut at 0.5 lies between that of the base
rate, which misses many toxic texts, and the balanced one, which drops clean ones.

Labelled rows fall into five folds by crc32 of the id's text: fold 0 is held
out, folds 1 to 3 train the models on at most `per_class` rows and `class_bytes`
bytes of text of each class, fold 4 fits the curve on at most `curve_rows`.
These bounds bound the models' tables, which are broadcast. The shared counts
are summed over every document and word of the corpus.

Edge cases: null and empty texts are scored like a text without evidence; a
document with several labels counts as toxic if one says so; null labels are
left out; a null id is not held out; without rows of both classes every score is
0; labels, lang, source and id are never inputs of a score; other columns pass
`accepted` unread, under any name and of any type.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm import _arrow as A
from lamina.llm._arrow import give_back
from lamina.llm._session import arrow_map, cut, named, unpacked, whole_rows

STEMS = (6, 4)
RANKS = (1, 2, 4)
SLICE = 1 << 20


def read(data: np.ndarray, offsets: np.ndarray):
    """Word hashes, the rows' offsets among them, and a function that hashes the stems of words."""
    data = A.LOWER[data]
    starts, ends, row = A.words(data, offsets, A.ALNUM)
    heads = np.flatnonzero((data & 0xC0) != 0x80)

    def stems(at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the first `size` characters of words; a shorter word is its own stem."""
        first = np.searchsorted(heads, starts[at]) + size
        stop = np.append(heads, len(data))[np.minimum(first, len(heads))]
        return A.mix(A.span_hashes(data, starts[at], np.minimum(stop, ends[at])) + A.U(size))

    return A.span_hashes(data, starts, ends), np.searchsorted(row, np.arange(len(offsets))), stems


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return A.mix(left * A.U(0x9E3779B97F4A7C15) + right)


def place(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key in a sorted table, len(table) where it is not."""
    at = np.searchsorted(table, keys)
    inside = np.minimum(at, len(table) - 1)
    return np.where(table[inside] == keys, inside, len(table)) if len(table) else np.zeros(len(keys), np.int64)


def before(h: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The word before each one, 0 at the start of a text."""
    out = np.r_[A.U(0), h[:-1]] if len(h) else h
    out[by[:-1][np.diff(by) > 0]] = 0
    return out


@dataclass
class Model:
    """Log-ratios toxic to ordinary.

    levels: for words, then stems, the sorted hashes and their ratios, one more
    entry for those that are unknown; what backs off adds what its own level
    leaves to the next. history: sorted hashes of words that a bigram may start
    with and the ratio of the weights they leave to the backoff. pairs: bigrams.
    """

    levels: list[tuple[np.ndarray, np.ndarray]]
    history: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]

    def ratios(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-ratio of each word by itself, of each word after the one before it, and the rows' offsets."""
        h, by, stems = read(data, offsets)
        keys, values = self.levels[0]
        at = place(keys, h)
        alone = values[at].astype(float)
        left = np.flatnonzero(at == len(keys))
        for size, (keys, values) in zip(STEMS, self.levels[1:], strict=True):
            at = place(keys, stems(left, size))
            alone[left] += values[at]
            left = left[at == len(keys)]
        v = before(h, by)
        keys, values = self.history
        out = alone + values[place(keys, v)]
        keys, values = self.pairs
        at = place(keys, pair(v, h))
        known = np.flatnonzero(at < len(keys))
        out[known] = values[at[known]]
        return alone, out, by

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per row: mean ratio of its words, and the ratios of its words of each rank in RANKS, most toxic first (0 if it has fewer)."""
        alone, each, by = self.ratios(data, offsets)
        out = np.zeros((len(offsets) - 1, 1 + len(RANKS)))
        size = np.diff(by)
        some = np.flatnonzero(size)
        if not len(some):
            return out
        total = np.r_[0.0, np.cumsum(each)]
        out[some, 0] = (total[by[1:]] - total[by[:-1]])[some] / size[some]
        for i in some.tolist():
            own = alone[by[i] : by[i + 1]]
            top = min(len(own), max(RANKS))
            best = -np.sort(-(np.partition(own, len(own) - top)[len(own) - top :]))
            for j, rank in enumerate(RANKS):
                if rank <= top:
                    out[i, 1 + j] = best[rank - 1]
        return out


def counts(docs: DataFrame) -> DataFrame:
    """How often each bigram stands in the texts of each class (v, w, t, o), with the stems of w; v is 0 at the start of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.buffer(A.rows(batch, "text"))
            label = np.asarray(A.rows(batch, "toxic")).astype(bool)
            for i, j in A.slices(offsets, SLICE):
                h, by, stems = read(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                toxic = np.repeat(label[i:j], np.diff(by))
                v = before(h, by)
                order = np.lexsort((h, v))
                v, w, toxic = v[order], h[order], toxic[order].astype(np.int64)
                head = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])]) if len(v) else np.zeros(0, np.int64)
                n = np.diff(np.r_[head, len(v)])
                t = np.add.reduceat(toxic, head) if len(head) else head
                kept = [v[head], w[head], *[stems(order[head], s) for s in STEMS]]
                yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in kept], pa.array(t), pa.array(n - t)], names=["v", "w", *[f"s{s}" for s in STEMS], "t", "o"])

    kinds = ", ".join(f"{c} long" for c in ["v", "w", *[f"s{s}" for s in STEMS], "t", "o"])
    found = arrow_map(docs.select("toxic", "text"), run, kinds)
    return found.groupBy("v", "w").agg(*[F.first(f"s{s}").alias(f"s{s}") for s in STEMS], F.sum("t").alias("t"), F.sum("o").alias("o"))


def corpus_counts(docs: DataFrame) -> DataFrame:
    """How often each distinct word of the corpus stands in it (w, stems, n); one row a word, in the shared checkpoint folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.buffer(batch.column(0))
            for i, j in A.slices(offsets, 2 * SLICE):
                h, _, stems = read(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                w, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([*[pa.array(x.view(np.int64)) for x in (w, *[stems(first, s) for s in STEMS])], pa.array(n)], names=["w", *[f"s{s}" for s in STEMS], "n"])

    kinds = ", ".join(f"{c} long" for c in ["w", *[f"s{s}" for s in STEMS], "n"])
    found = arrow_map(docs.select("text"), run, kinds)
    return cut(found.groupBy("w").agg(*[F.first(f"s{s}").alias(f"s{s}") for s in STEMS], F.sum("n").alias("n")))


def collected(frame: DataFrame, columns: list[str]) -> list[np.ndarray]:
    table = frame.select(*columns).toArrow()
    return [np.asarray(table.column(x).combine_chunks()) for x in columns]


def discount(n: np.ndarray) -> float:
    """n1 / (n1 + 2 n2) from the counts of counts."""
    one, two = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
    return one / (one + 2 * two) if one and two else 0.75


def interpolated(n: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, float]:
    """Smoothed shares of counts n, each parent being what the backoff gives it; and the weight of the backoff."""
    d, total = discount(n), max(1, n.sum())
    left = d * np.count_nonzero(n) / total
    return np.maximum(n - d, 0) / total + left * parent, left


def fit_models(docs: DataFrame, corpus: DataFrame) -> Model | None:
    """docs: text and toxic of the training rows. Counts of their bigrams and the corpus counts of their words reach the driver; the bounds on training rows and bytes bound both."""
    grams = cut(counts(docs))
    v, w, toxic, ordinary = collected(grams.select("v", "w", F.col("t").cast("int").alias("t"), F.col("o").cast("int").alias("o")), ["v", "w", "t", "o"])
    if not (toxic.any() and ordinary.any()):
        return None
    names = [f"s{s}" for s in STEMS]
    words, *above = collected(grams.groupBy("w").agg(*[F.first(s).alias(s) for s in names]), ["w", *names])
    v, w, words, *above = (x.view(np.uint64) for x in (v, w, words, *above))
    order = np.argsort(words)
    words, above = words[order], [s[order] for s in above]  # stems of each word
    of = place(words, w)
    tables = [np.unique(s) for s in above]
    everything = corpus_counts(corpus)
    spark = corpus.sparkSession
    held = spark.createDataFrame(pa.table({"w": words.view(np.int64)}))
    total = everything.agg(F.sum("n")).first()[0] or 1
    shared = [np.zeros(len(words)), *[np.zeros(len(t)) for t in tables]]
    found = [everything.join(F.broadcast(held), "w").select("w", "n")]  # the words of the training rows
    for s, table in zip(STEMS, tables, strict=True):
        names = spark.createDataFrame(pa.table({f"s{s}": table.view(np.int64)}))
        found.append(everything.groupBy(f"s{s}").agg(F.sum("n").alias("n")).join(F.broadcast(names), f"s{s}").select(F.col(f"s{s}").alias("w"), "n"))
    for out, keys, frame in zip(shared, [words, *tables], found, strict=True):
        k, n = collected(frame, ["w", "n"])
        out[place(keys, k.view(np.uint64))] = n
    shared = [np.maximum(x, 1) for x in shared]
    up = [place(t, s) for t, s in zip(tables, above, strict=True)]  # place of each word's stem
    chain = [np.zeros(len(t), np.int64) for t in tables[:-1]]  # place of each stem's shorter stem
    for i in range(len(chain)):
        chain[i][up[i]] = up[i + 1]
    classes, weights = [], []
    history, at_history = np.unique(v, return_inverse=True)
    for n in (toxic, ordinary):
        some = n > 0
        types = np.bincount(of[some], minlength=len(words))  # in how many bigrams a word stands
        kinds = [np.bincount(u[types > 0], minlength=len(t)) for u, t in zip(up, tables, strict=True)]  # how many words a stem has
        shares, lefts = [], []
        parent = shared[-1] / total
        for i in range(len(tables) - 1, -1, -1):
            share, left = interpolated(kinds[i], parent)
            shares.insert(0, share)
            lefts.insert(0, left)
            link = chain[i - 1] if i else up[0]  # of what backs off to this level
            parent = share[link] * shared[i] / shared[i + 1][link]
        word, left = interpolated(types, parent)
        classes.append([word, *shares])
        lefts.insert(0, left)
        d = discount(n[some])
        follow, follows = np.bincount(at_history, n, minlength=len(history)), np.bincount(at_history[some], minlength=len(history))
        back = np.where(follow > 0, d * follows / np.maximum(follow, 1), 1.0)
        bigram = np.maximum(n - d, 0) / np.maximum(follow[at_history], 1) + back[at_history] * word[of]
        weights.append((lefts, back, bigram))
    ratio = lambda a, b: np.log(a / b).astype(np.float32)
    levels = []
    for i, keys in enumerate([words, *tables]):
        unknown = ratio(np.array([weights[0][0][i]]), np.array([weights[1][0][i]]))  # what is not here goes on with what this level leaves
        levels.append((keys, np.r_[ratio(classes[0][i], classes[1][i]), unknown]))
    keys = pair(v, w)
    order = np.argsort(keys)
    return Model(levels, (history, np.r_[ratio(weights[0][1], weights[1][1]), np.float32(0)]), (keys[order], ratio(weights[0][2], weights[1][2])[order]))


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Logistic regression by Newton steps on standardised columns, a class weighing the square root of its rows; weights for raw columns, the constant last."""
    if not len(y) or y.min() == y.max():
        return np.r_[np.ones(x.shape[1]), -1.0]
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    weight = np.where(y > 0, (y > 0).mean() ** -0.5, (y <= 0).mean() ** -0.5)
    weight /= weight.mean()
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(b))
        b -= np.linalg.solve(hessian, z.T @ (weight * (p - y)) + ridge * len(y) * b)
    return np.r_[b[:-1] / spread, b[-1] - (b[:-1] * mean / spread).sum()]


NAMES = ["mean_ratio", *[f"ratio_{r}" for r in RANKS]]


def measured(rows: DataFrame, shared, at: int) -> DataFrame:
    """Adds the evidences to a table of one struct column, `row`, whose field number `at` is the text. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            data, offsets = A.buffer(row.field(at))
            found = [shared.value.evidence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in A.slices(offsets)]
            x = np.concatenate(found) if found else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([row, *map(pa.array, x.T.copy())], names=["row", *NAMES])

    return arrow_map(rows, run, T.StructType([T.StructField("row", rows.schema["row"].dataType), *[T.StructField(c, T.DoubleType()) for c in NAMES]]))


def fold_of(key):
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5))


def chosen_rows(base: DataFrame, labels: DataFrame, per_class: int, class_bytes: int, curve_rows: int) -> DataFrame:
    """doc_id, text, toxic, fold of the rows to learn from; they are chosen by hash order, so the choice does not depend on the data's layout."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.withColumn("fold", fold_of(F.col("doc_id"))).where("fold > 0").withColumn("z", F.xxhash64("doc_id"))
    some = [known.where(f"fold < 4 and toxic = {c}").orderBy("z", "doc_id").limit(per_class) for c in (0, 1)]
    some.append(known.where("fold = 4").orderBy("z", "doc_id").limit(curve_rows))
    chosen = some[0].unionByName(some[1]).unionByName(some[2]).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "fold", "z")
    rows = base.join(F.broadcast(chosen), "doc_id")  # at most 2 per_class + curve_rows ids
    sizes = rows.select("doc_id", "toxic", F.least("fold", F.lit(4)).alias("fold"), "z", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).toPandas()
    sizes["part"] = np.where(sizes["fold"] == 4, 2, sizes["toxic"])
    sizes = sizes.sort_values(["part", "z", "doc_id", "n"], kind="stable")
    over = sizes[(sizes.groupby("part")["n"].cumsum() > class_bytes) & (sizes["part"] < 2)]
    return rows.where(~F.col("doc_id").isin(over["doc_id"].tolist())) if len(over) else rows


def scored(docs: DataFrame, labels: DataFrame, per_class: int = 2000, class_bytes: int = 16 << 20, curve_rows: int = 4000, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """row (the document's columns), the evidences, score and predicted of every document; documents are not shuffled."""
    spark = docs.sparkSession
    base = docs.select(named(id_column).cast("long").alias("doc_id"), named(text).cast("string").alias("text"))
    rows = chosen_rows(base, labels, per_class, class_bytes, curve_rows)
    model = fit_models(rows.where("fold < 4"), base)
    give_back()
    whole = docs.select(whole_rows(docs))
    if model is None:
        zero = F.lit(0.0)
        return whole.select("row", *[zero.alias(c) for c in NAMES], zero.alias("score"), F.lit(0).alias("predicted"))
    shared = spark.sparkContext.broadcast(model)
    fitted = rows.where("fold = 4").select(F.struct("toxic", "text").alias("row"))
    seen = measured(fitted, shared, 1).select("row.toxic", *NAMES).toPandas()  # at most curve_rows
    weights = curve(seen[NAMES].to_numpy(float), seen["toxic"].to_numpy(float)).tolist()
    line = sum((F.col(c) * w for c, w in zip(NAMES, weights, strict=False)), F.lit(weights[-1]))
    out = measured(whole, shared, docs.columns.index(text))
    return out.withColumn("score", 1 / (1 + F.exp(-line))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted and the evidences of every document."""
    out = scored(docs.select("doc_id", "text"), labels, **options).withColumn("doc_id", F.col("row.doc_id").cast("long"))
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted", *NAMES)


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted to be toxic, in their columns."""
    return scored(docs, labels, **options).where("predicted = 0").select(*unpacked(docs.columns))
