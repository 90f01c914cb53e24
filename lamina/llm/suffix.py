"""Removal of byte strings that occur in an earlier document, by a logarithmic family of suffix arrays.

The suffixes are those of the stretches that can repeat (see `_repeats`), dealt
out by pivot. In each task they come in batches, in document order. A batch gets
its suffix array: its suffixes in the order of their bytes, to the depth of the
match length (50), as longer matches need not be told apart. The array is
merge-scanned against the levels that exist, which hold earlier documents only;
a suffix that meets one with 50 equal bytes is a match. What is new becomes a
level, and levels of equal size merge geometrically, so a suffix is merged a
logarithmic number of times.

Edge cases: a null or empty text has no bytes; texts under 50 bytes are kept
whole; rows of the same id never remove each other's bytes; a null id counts as
the greatest; other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import _arrow as A
from lamina.llm import _repeats as R

BATCH = 1 << 19


def suffix_keys(body: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The first bytes of the suffixes at these places, as strings that compare by byte: each byte is raised by one, since UTF-8 has no 255 and numpy's strings end at a 0."""
    raised = body + np.uint8(1)
    rows = np.ndarray((max(0, len(raised) - length + 1), length), np.uint8, raised.data, strides=(1, 1))
    return rows[at].view(f"S{length}").ravel()


class Levels:
    """A logarithmic family: sorted arrays of distinct suffixes, each at least twice as long as the next."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def seen(self, suffixes: np.ndarray) -> np.ndarray:
        """Which of the suffixes, in order, a level holds: one merge scan of both sorted arrays a level."""
        found = np.zeros(len(suffixes), bool)
        for level in self.levels:
            at = np.searchsorted(level, suffixes)
            at[at == len(level)] = 0
            found |= level[at] == suffixes
        return found

    def add(self, suffixes: np.ndarray) -> None:
        """Adds sorted suffixes that no level holds; a stable sort of two sorted arrays merges them."""
        if len(suffixes):
            self.levels.append(suffixes)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            last = self.levels.pop()
            both = np.concatenate([self.levels.pop(), last])
            both.sort(kind="stable")
            self.levels.append(both)


def earlier_documents(block: R.Block):
    """Windows that a document with a smaller key holds too."""
    length, body, at, key = block.how.length, block.body, block.at, block.key
    order = np.argsort(key, kind="stable")
    by_key, again, index = key[order], np.zeros(len(key), bool), Levels()
    i = 0
    while i < len(order):
        j = min(len(order), i + BATCH)
        j = int(np.searchsorted(by_key, by_key[j - 1], "right"))  # a document is never split
        mine = order[i:j]
        suffixes = suffix_keys(body, at[mine], length)
        array = np.argsort(suffixes, kind="stable")  # equal ones stay in document order
        suffixes, mine = suffixes[array], mine[array]
        head = np.flatnonzero(np.r_[True, suffixes[1:] != suffixes[:-1]])
        group = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(mine)]))
        first = suffixes[head]
        old = index.seen(first)
        again[mine] = old[group] | (key[mine] > key[mine[head]][group])
        if j < len(order):
            index.add(first[~old])
        i = j
    return (again,)


def finish(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.buffer(A.rows(batch, "text"))
            spans, by_span = R.listed(A.rows(batch, "found"), R.SPAN)
            gone, counts, runs, begins, sizes = [], [], [], [], []
            for i, j in A.slices(offsets):
                own = offsets[i : j + 1] - offsets[i]
                hit = R.covered(own, spans, by_span, i, j, length)
                edge = np.zeros(len(hit) + 1, bool)
                edge[own] = True
                rise, fall = hit.copy(), hit.copy()
                rise[1:] &= ~hit[:-1] | edge[1 : len(hit)]
                fall[:-1] &= ~hit[1:] | edge[1 : len(hit)]
                up, down = np.flatnonzero(rise), np.flatnonzero(fall) + 1
                row = np.searchsorted(own, up, "right") - 1
                gone.append(hit)
                counts.append(R.per_row(hit, own))
                runs.append(R.per_row(rise, own))
                begins.append(up - own[row])
                sizes.append(down - up)
            join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
            gone, counts, runs = join(gone, bool), join(counts, np.int64), join(runs, np.int64)
            kept = np.r_[0, np.cumsum(np.diff(offsets) - counts)].astype(np.int32)
            cuts = np.r_[0, np.cumsum(runs)].astype(np.int32)
            pieces = pa.StructArray.from_arrays([pa.array(join(begins, np.int64)), pa.array(join(sizes, np.int64))], names=["start", "length"])
            yield pa.RecordBatch.from_arrays(
                [
                    A.rows(batch, "k"),
                    A.rows(batch, "none"),
                    pa.array(np.diff(offsets)),
                    pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(cuts), pieces),
                    pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(kept.tobytes()), pa.py_buffer(data[~gone].tobytes())]),
                ],
                names=["k", "none", "n_bytes", "n_removed", "spans", "kept"],
            )

    return run


def dedup(docs: DataFrame, length: int = 50, gram: int = 16, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, the removed spans (byte start and length) and the kept bytes of each document."""
    how = R.Symbols(length, min(gram, length), words=False, within=False, early=False)
    schema = "n_bytes long, n_removed long, spans array<struct<start: long, length: long>>, kept binary"
    return R.repeats(docs, how, earlier_documents, finish(length), schema, id_column, text)


def digests(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
