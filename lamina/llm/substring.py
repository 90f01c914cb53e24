"""Removal of word windows that occur earlier, by relative Lempel-Ziv parsing.

The reference is the corpus before a word, cut into blocks: the stretches of
text that share a pivot (see `_repeats`), indexed by it. A stretch of a document
can only match inside the block of its own pivot, so it is parsed against that
block and none other. Parsing is greedy: where a window of 20 words is found
earlier in the block, a factor starts that refers to the earliest such place and
runs on as far as document and reference agree. Where it ends, windows across
the boundary are looked up until one is found, which starts the next factor.
Factors of at least 20 words are duplicate spans, and what they cover is
removed. Where a block ends, factors that go on in the same source are joined
again when the document's factors come together. Words are compared by their
bytes before anything is removed.

Edge cases: a null or empty text has no words; texts under 20 words are kept;
words come back joined by one space; equal ids are told apart by their text,
and rows that share both count as one document; a null id counts as the
greatest; other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import _arrow as A
from lamina.llm import _repeats as R


def parsed(block: R.Block):
    """Greedy factors of every stretch of a block: a mask of the windows that they cover, and key and place of what each of these refers to."""
    group, key, start = block.groups(), block.key, block.start
    order = np.lexsort((start, key, group))
    head = order[np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])] if len(order) else order
    source = head[group] if len(order) else order  # the earliest window of equal words
    old = (key != key[source]) | (start != start[source])
    n = len(group)
    last = block.ends[block.of] - 1  # the last window of each one's stretch
    following = np.minimum.accumulate(np.where(old, np.arange(n), n)[::-1])[::-1]  # the next window that is found earlier
    again, doc, at = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    here = following[block.ends - block.count] if n else following
    here = here[(here < n)]
    here = np.unique(here)
    limit = np.r_[last, -1]
    while len(here):
        reach = np.minimum(limit[here] - here, limit[source[here]] - source[here]) + 1
        step = R.spread(np.zeros(len(here), np.int64), reach)
        each = np.repeat(np.arange(len(here)), reach)
        agree = group[here[each] + step] == group[source[here][each] + step]
        firsts = np.cumsum(reach) - reach
        size = np.minimum.reduceat(np.where(agree, reach[each], step), firsts)
        inside = R.spread(here, size)
        from_ = np.repeat(source[here] - here, size) + inside
        again[inside], doc[inside], at[inside] = True, key[from_], start[from_]
        after = here + size
        more = after <= limit[here]
        bound = limit[here][more]
        here = following[after[more]]
        here = here[(here <= bound)]
    return again, doc, at


def whole_factors(row: np.ndarray, found: np.ndarray, length: int):
    """Factors of a batch in reading order, joined where document and source both go on; row, first word, words, source and its word."""
    order = np.lexsort((found["start"], row))
    row, found = row[order], found[order]
    start, count, at, doc = (found[c].astype(np.int64) for c in ("start", "count", "from", "doc"))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + count[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + count[:-1])
    head = np.flatnonzero(new)
    words = np.add.reduceat(count, head) + length - 1 if len(head) else count
    return row[head], start[head], words, doc[head], at[head]


def finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.buffer(A.rows(batch, "text"))
            found, by_span = R.listed(A.rows(batch, "found"), R.FACTOR)
            n_words, n_removed, texts, sizes = [], [], [], []
            for i, j in A.slices(offsets):
                base = offsets[i]
                raw, own = data[base : offsets[j]].copy(), offsets[i : j + 1] - base
                starts, ends, row = A.words(raw, own)
                by = np.searchsorted(row, np.arange(j - i + 1))
                gone = R.covered(by, found, by_span, i, j, length)
                keep = np.flatnonzero(~gone)
                more = np.r_[row[keep][1:] == row[keep][:-1], False] if len(keep) else np.zeros(0, bool)
                raw[ends[keep][more]] = 0x20
                edge = np.bincount(starts[keep], minlength=len(raw) + 2) - np.bincount(ends[keep] + more, minlength=len(raw) + 2)
                kept = np.cumsum(edge[: len(raw)]) > 0
                n_words.append(np.diff(by))
                n_removed.append(R.per_row(gone, by))
                texts.append(raw[kept])
                sizes.append(R.per_row(kept, own))
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            row, start, words, doc, at = whole_factors(np.repeat(np.arange(batch.num_rows), np.diff(by_span)), found, length)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            pieces = pa.StructArray.from_arrays([pa.array(x) for x in (start, words, doc, at)], names=["start", "length", "source_id", "source_start"])
            ends = np.r_[0, np.cumsum(join(sizes))].astype(np.int32)
            kept = np.concatenate(texts) if texts else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    A.rows(batch, "k"),
                    A.rows(batch, "none"),
                    pa.array(join(n_words).astype(np.int64)),
                    pa.array(join(n_removed).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(cuts), pieces),
                    pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes())]),
                ],
                names=["k", "none", "n_words", "n_removed", "factors", "kept"],
            )

    return run


def dedup(docs: DataFrame, length: int = 20, gram: int = 8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_removed, the factors (word start, length, source) and the kept text of each document."""
    how = R.Symbols(length, min(gram, length), words=True, within=True)
    schema = "n_words long, n_removed long, factors array<struct<start: long, length: long, source_id: long, source_start: long>>, kept string"
    return R.repeats(docs, how, parsed, finish(length), schema, id_column, text)


def digests(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
s AS (SELECT doc_id, p, array_to_string(w[p : p + 19], ' ') AS content FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
m AS (SELECT doc_id, p, CAST(row_number() OVER (PARTITION BY content ORDER BY doc_id, p) > 1 AS INT) AS again FROM s),
c AS (SELECT doc_id, p, word, coalesce(max(again) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone FROM x LEFT JOIN m USING (doc_id, p))
SELECT d.doc_id, count(word) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id
"""
