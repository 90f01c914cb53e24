"""Exact search for repeated runs of `length` symbols, in two passes over small records.

A text is a row of symbols (bytes or words). Each window of `length` symbols
has a pivot: the least hash among the grams of `gram` symbols that it holds.
Windows of equal content have equal pivots, and neighbouring windows mostly
share theirs, so a text falls into short stretches of one pivot each.

Pass 1 deals the pivots out by hash and finds those that occur in more than one
place; most do not, and their stretches are dropped. Pass 2 deals out the
stretches that are left, with their text, into blocks keyed by pivot, and
`settle` says which of a block's windows repeat an earlier one. Hashes choose
candidates only; `settle` compares symbols. Both passes settle what repeats
inside one Arrow batch at once and send one representative on, so the largest
group that meets in a task has a record per batch, not per row. Records travel
as packed columns, dealt to a number of tasks that follows the table's size.
They name a document by its group of rows (those whose records were made
together) and its place there, in few bytes however many tasks there are; the
keys of a group's rows travel once, to the task that gathers its results.
Whole texts cross the network once, keyed by document; both joins share that
exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import _arrow as A
from lamina.llm._session import arrow_map, named, tasks_for

LAST = (1 << 63) - 1
#: Text whose records are made at a time.
GROUP_BYTES = 1 << 21
#: Table bytes (by the optimiser's estimate) for each task that gathers records.
TASK_BYTES = 4 << 20


@dataclass(frozen=True)
class Symbols:
    """How texts become symbols, and which windows count as repeats.

    within: windows that repeat an earlier one of the same document count too.
    early: a batch settles its windows before they travel, not only its equal stretches.
    """

    length: int
    gram: int
    words: bool
    within: bool
    early: bool = True

    def read(self, data: np.ndarray, offsets: np.ndarray):
        """Symbols, their offsets by row, and word bounds."""
        if not self.words:
            return A.BYTE_CODE[data], offsets, None
        starts, ends, rows = A.words(data, offsets)
        return A.span_hashes(data, starts, ends), np.searchsorted(rows, np.arange(len(offsets))), (starts, ends)


def windows_inside(offsets: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which window starts have their whole window in one row."""
    count = max(0, n - length + 1)
    edge = np.zeros(count + 1, np.int32)
    good = np.diff(offsets) >= length
    edge[offsets[:-1][good]] += 1
    np.subtract.at(edge, offsets[1:][good] - length + 1, 1)
    return np.cumsum(edge[:-1]) > 0


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then those of the next range."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def lanes_of(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every place of data, as numbers; beyond the end come zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of data at a and b, as long as size says, have equal bytes."""
    lanes, same, who = lanes_of(data), np.ones(len(a), bool), np.arange(len(a))
    done = 0
    while len(who):
        mask = A.TAIL[np.minimum(size[who] - done, 8)]
        same[who] = (lanes[a[who] + done] & mask) == (lanes[b[who] + done] & mask)
        done += 8
        who = who[same[who] & (size[who] > done)]
    return same


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word; two words have one number just if their bytes are equal."""
    h, size = A.span_hashes(data, starts, ends), ends - starts
    if not len(h):
        return h.astype(np.int64)
    order = np.argsort(h, kind="stable")
    group = groups(h[order])
    first = order[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])][group]
    out = np.empty(len(h), np.int64)
    out[order] = group
    if not ((size[order] == size[first]) & equal_spans(data, starts[order], starts[first], size[first])).all():
        known: dict[bytes, int] = {}  # two words of one hash
        out = np.array([known.setdefault(data[i:j].tobytes(), len(known)) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return out


class Block:
    """Stretches with their text: raw bytes, how many of them and how many windows each stretch has, its first window's place in the document, and the document's key."""

    def __init__(self, how: Symbols, body: np.ndarray, size: np.ndarray, count: np.ndarray, start: np.ndarray, key: np.ndarray) -> None:
        self.how, self.body = how, body
        cuts = np.r_[0, np.cumsum(size)].astype(np.int64)
        if how.words:
            self.begin, self.end, row = A.words(body, cuts)
            self.symbols, self.by = numbered(body, self.begin, self.end), np.searchsorted(row, np.arange(len(cuts)))
        else:
            self.begin, self.end, self.symbols, self.by = np.arange(len(body)), np.arange(1, len(body) + 1), body, cuts
        self.count = count.astype(np.int64)
        self.ends = np.cumsum(self.count)
        self.at = spread(self.by[:-1], self.count)  # each window's first symbol
        self.of = np.repeat(np.arange(len(count), dtype=np.int32), self.count)
        self.start = self.at + (start.astype(np.int64) - self.by[:-1])[self.of]
        self.key = key[self.of]

    def groups(self) -> np.ndarray:
        """A number for each window; two windows have one number just if their symbols are equal."""
        n = self.how.length
        if not len(self.at):
            return self.at
        window = A.roll(A.mix(self.symbols.astype(np.uint64) + A.U(1)), n)[self.at]
        order = np.argsort(window, kind="stable")
        group = groups(window[order])
        head = order[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])]
        out = np.empty(len(group), np.int64)
        out[order] = group
        a, b = self.at, self.at[head][out]
        if self.how.words:
            same = np.ones(len(a), bool)
            for i in range(n):
                same &= self.symbols[a + i] == self.symbols[b + i]
        else:
            same = equal_spans(self.body, a, b, np.full(len(a), n))
        if not same.all():  # two windows of one hash
            _, out = np.unique(self.symbols[a[:, None] + np.arange(n)], axis=0, return_inverse=True)
            out = out.ravel()
        return out


def unsettled(block: Block):
    """No window is settled yet."""
    return (np.zeros(len(block.at), bool),)


def looked_into(how: Symbols, settle, body: np.ndarray, size: np.ndarray, count: np.ndarray, start: np.ndarray, key: np.ndarray):
    """Settles stretches with their text.

    Of stretches with equal bytes the earliest one is looked into, the others
    repeat it as a whole. Returns the block of those that are looked into, which
    stretches they are, the mask of their windows and the windows' sources, and
    of the others the number of the one that each repeats (-1: none).
    """
    size, count, start = (x.astype(np.int64) for x in (size, count, start))
    cuts = np.r_[0, np.cumsum(size)]
    h, whole = A.span_hashes(body, cuts[:-1], cuts[1:]), np.arange(len(size))
    order = np.lexsort((start, key, h))
    if len(order):
        group = groups(h[order])
        first = order[np.flatnonzero(np.r_[True, group[1:] != group[:-1]])][group]
        same = (size[order] == size[first]) & equal_spans(body, cuts[order], cuts[first], size[first])
        whole[order] = np.where(same, first, order)
    own = key == key[whole]  # a document does not repeat itself
    if how.within:  # but for another place of it; the same place comes again with a repeated row
        own &= start == start[whole]
    whole = np.where(own, np.arange(len(size)), whole)
    mine = np.flatnonzero(whole == np.arange(len(size)))
    block = Block(how, body[spread(cuts[mine], size[mine])], size[mine], count[mine], start[mine], key[mine])
    return block, mine, *settle(block), np.where(whole == np.arange(len(size)), -1, whole)


def stretches(symbols: np.ndarray, offsets: np.ndarray, how: Symbols):
    """First window, number of windows, pivot and row of each stretch."""
    empty = np.zeros(0, np.int64)
    if len(symbols) < how.length:
        return empty, empty, empty.astype(np.uint64), empty
    pivot = A.sliding_min(A.roll(symbols, how.gram), how.length - how.gram + 1)
    inside = windows_inside(offsets, len(symbols), how.length)
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (pivot[1:] != pivot[:-1])
    over = inside.copy()
    over[:-1] &= ~inside[1:] | (pivot[1:] != pivot[:-1])
    first, last = np.flatnonzero(fresh), np.flatnonzero(over)
    return first, last - first + 1, pivot[first], np.searchsorted(offsets, first, "right") - 1


def self_repeating(symbols: np.ndarray, first: np.ndarray, count: np.ndarray, how: Symbols) -> np.ndarray:
    """Stretches that may hold equal windows: long ones, and those where a window comes again within the reach of one gram."""
    reach = how.length - how.gram + 1
    window = A.roll(symbols, how.length)
    again = np.zeros(len(window) + 1, bool)
    for d in range(1, min(reach, len(window))):
        again[:-1][:-d] |= window[:-d] == window[d:]
    total = np.r_[0, np.cumsum(again)]
    return (count > reach) | (total[first + count] > total[first])


def murmur_keys(n: int) -> np.ndarray:
    """For each of n hash partitions an int key that Spark's hash sends there."""
    with np.errstate(over="ignore"):
        keys = np.arange(64 * n + 1024, dtype=np.uint32)
        turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
        h = np.uint32(42) ^ (turn(keys * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
        h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
    part = h.view(np.int32).astype(np.int64) % n
    got, at = np.unique(part, return_index=True)
    out = np.arange(n, dtype=np.int64)
    out[got] = at
    return out


def pack(*columns: np.ndarray) -> bytes:
    head = np.array([len(columns), *[c.nbytes for c in columns]], "<i8").tobytes()
    raw = head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


#: Kinds of columns that travel as their steps, which compress well where the numbers ascend: numbers below 2^32, and any.
STEPS, FAR_STEPS = "steps", "far steps"


def steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values.astype(np.int64), prepend=0).astype("<i4")


def far_steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values.astype("<i8"), prepend=np.int64(0))  # beyond 63 bits the steps wrap, and so does their sum


def unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = memoryview(pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8), 8 * (n + 1), []
    for kind, size in zip(kinds, sizes, strict=True):
        part = np.frombuffer(raw[at : at + size], {STEPS: "<i4", FAR_STEPS: "<i8"}.get(kind, kind))
        if kind in (STEPS, FAR_STEPS):
            part = np.cumsum(part, dtype=np.int64)
        out.append(part.astype("<u4") if kind == STEPS else part)
        at += int(size)
    return out


#: Kinds of records: entries to be settled, settled values, the keys of a group's rows.
ENTRIES, VALUES, KEYS = 0, 1, 2


def dealt(bucket: np.ndarray, keys: np.ndarray, make: Callable[[np.ndarray], bytes], kind: int = ENTRIES) -> pa.RecordBatch:
    """One packed record for each bucket that has entries; make gets their positions."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(len(keys) + 1))
    used = np.flatnonzero(np.diff(cuts))
    blobs = [make(order[cuts[b] : cuts[b + 1]]) for b in used]
    return pa.RecordBatch.from_arrays([pa.array(keys[used].astype(np.int32)), pa.array(np.full(len(used), kind, np.int8)), pa.array(blobs, pa.binary())], names=["bucket", "kind", "payload"])


def groups(values: np.ndarray) -> np.ndarray:
    """Group number of each of sorted values."""
    return np.cumsum(np.r_[False, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)


SPAN = np.dtype([("start", "<u4"), ("count", "<u4")])
FACTOR = np.dtype([("start", "<u4"), ("count", "<u4"), ("from", "<u4"), ("doc", "<i8")])


def factors(again: np.ndarray, row: np.ndarray, start: np.ndarray, doc: np.ndarray | None = None, at: np.ndarray | None = None):
    """Row and packed record of each greatest run of marked windows; with sources (doc, at), a run also ends where its source does."""
    index = np.flatnonzero(again)
    row, start = row[index], start[index]
    cut = np.ones(len(index), bool)
    cut[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    if doc is not None:
        doc, at = doc[index], at[index]
        cut[1:] |= (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(cut)
    out = np.zeros(len(head), SPAN if doc is None else FACTOR)
    out["start"], out["count"] = start[head], np.diff(np.r_[head, len(index)])
    if doc is not None:
        out["doc"], out["from"] = doc[head], at[head]
    return row[head], out


def all_factors(how: Symbols, block: Block, mine: np.ndarray, again: np.ndarray, source: list, whole: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray):
    """factors() of what looked_into() returns: runs inside the stretches that were looked into, and the stretches that repeat another."""
    of, out = factors(again, row[mine[block.of]], block.start, *source)
    others = np.flatnonzero(whole >= 0)
    more = np.zeros(len(others), out.dtype)
    more["start"], more["count"] = start[others], count[others]
    if how.within:
        more["doc"], more["from"] = key[whole[others]], start[whole[others]]
    return np.concatenate([of, row[others]]), np.concatenate([out, more])


FOUND = "k long, h long, found binary"
RECORD = "bucket int, kind tinyint, payload binary"
#: Kinds of the columns that tell documents: number in the group of rows, group, and the key of the group in two parts.
DOCUMENTS = [STEPS, STEPS, "<i8", "<i8"]


class Group:
    """Rows whose records are made together, and their key; equal rows have equal keys, whichever task makes them."""

    def __init__(self, k: np.ndarray, h: np.ndarray) -> None:
        self.k, self.h = k, h
        self.key = k[:1], np.frombuffer(xxhash.xxh3_64_digest(k.tobytes() + h.tobytes()), "<i8")

    def keys_of_rows(self, keys: np.ndarray) -> pa.RecordBatch:
        return dealt(bucket_of(*self.key, len(keys)), keys, lambda _: pack(self.k, self.h, *self.key), KEYS)

    def documents(self, rows: np.ndarray) -> list[np.ndarray]:
        """Columns that tell these rows."""
        return [steps(rows), steps(np.zeros(len(rows), np.int64)), *self.key]

    def settled(self, row: np.ndarray, values: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        return settled(row, values, np.arange(len(self.k)), np.zeros(len(self.k), np.int64), *self.key, keys)


def bucket_of(gk: np.ndarray, gh: np.ndarray, n: int) -> np.ndarray:
    return (A.mix(gk.view(np.uint64) ^ A.mix(gh.view(np.uint64))) % A.U(n)).astype(np.int64)


def settled(document: np.ndarray, values: np.ndarray, rows: np.ndarray, group: np.ndarray, gk: np.ndarray, gh: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Settled values, packed and dealt by the group of their document's row."""

    def make(at: np.ndarray) -> bytes:
        first = values["start"] if values.dtype.names else values
        at = at[np.lexsort((first[at], document[at]))]
        used, place = np.unique(document[at], return_inverse=True)
        some, of = np.unique(group[used], return_inverse=True)
        return pack(values[at], steps(place), steps(rows[used]), steps(of), gk[some], gh[some])

    return dealt(bucket_of(gk, gh, len(keys))[group[document]], keys, make, VALUES)


def columns(batch: pa.RecordBatch):
    return np.asarray(A.rows(batch, "k")), np.asarray(A.rows(batch, "h"))


def pivots(how: Symbols, keys: np.ndarray):
    """Pass 1, map side: the pivots of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h = columns(batch)
            data, offsets = A.buffer(A.rows(batch, "text"))
            for span in A.slices(offsets, GROUP_BYTES):
                yield from one(k, h, data, offsets, *span)

    def one(k, h, data, offsets, low, high) -> Iterator[pa.RecordBatch]:
        docs, got = Group(k[low:high], h[low:high]), []
        for i, j in A.slices(offsets[low : high + 1]):
            i, j = i + low, j + low
            base = offsets[i]
            symbols, by, _ = how.read(data[base : offsets[j]], offsets[i : j + 1] - base)
            first, count, pivot, row = stretches(symbols, by, how)
            own = self_repeating(symbols, first, count, how) if how.within else np.zeros(len(first), bool)
            got.append((pivot, row + (i - low), (first - by[row]).astype("<u4"), own))
        pivot, row, start, own = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.argsort(pivot, kind="stable")
        pivot, row, start, own = pivot[order], row[order], start[order], own[order]
        group = groups(pivot)
        if not len(group):
            return
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        if how.within:
            shared = (np.diff(np.r_[head, len(group)]) > 1) | np.logical_or.reduceat(own, head)
        else:
            shared = np.minimum.reduceat(docs.k[row], head) != np.maximum.reduceat(docs.k[row], head)
        here = shared[group]
        yield docs.keys_of_rows(keys)
        yield docs.settled(row[here], start[here], keys)
        # one for each group that is settled; the others are of one document, and each must hear
        sent = ~here
        sent[head] = True
        shared, pivot, row, start = here[sent], pivot[sent], row[sent], start[sent]
        order = np.lexsort((start, row))  # in reading order places and starts travel as small steps
        shared, pivot, row, start = shared[order], pivot[order], row[order], start[order]

        mixed = A.mix(pivot)
        code = (mixed >> A.U(32)).astype("<u4")  # within a bucket; the rare clash only costs a candidate

        def make(at: np.ndarray) -> bytes:
            used, place = np.unique(row[at], return_inverse=True)
            return pack(code[at], steps(place), steps(start[at]), shared[at], far_steps(docs.k[used]), *docs.documents(used))

        yield dealt((mixed % A.U(len(keys))).astype(np.int64), keys, make)

    return run


def gather(batches: Iterator[pa.RecordBatch], kinds: list, wanted: int = ENTRIES):
    """Packed records of one kind in a partition, columns joined; the column at 1 points into those that tell documents, which end each record, and their third last column into the last two. Second result: records of other kinds."""
    parts, documents, groups_, others = [], 0, 0, []
    for batch in batches:
        mine = np.asarray(batch.column(1)) == wanted
        if not mine.all():
            others.append(batch.filter(pa.array(~mine)))
        for blob in batch.column(2).filter(pa.array(mine)):
            part = unpack(blob.as_py(), kinds + DOCUMENTS)
            part[1] = part[1].astype(np.int64) + documents
            part[-3] = part[-3].astype(np.int64) + groups_
            documents += len(part[-3])
            groups_ += len(part[-1])
            parts.append(part)
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None, others


def shared_pivots(how: Symbols, keys: np.ndarray):
    """Pass 1, reduce side: where the pivots are that occur in more than one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, others = gather(batches, ["<u4", STEPS, STEPS, "?", FAR_STEPS])
        yield from others
        if got is None:
            return
        pivot, row, start, known, k, *docs = got
        order = np.argsort(pivot, kind="stable")
        group, row, known = groups(pivot[order]), row[order], known[order]
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        shared = np.logical_or.reduceat(known, head)
        if how.within:
            shared |= np.diff(np.r_[head, len(group)]) > 1
        else:
            shared |= np.minimum.reduceat(k[row], head) != np.maximum.reduceat(k[row], head)
        here = shared[group] & ~known
        yield settled(row[here], start[order][here], *docs, keys)

    return run


def by_document(kind):
    """All settled values of each document in these groups, as one record (k, h, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, others = gather(batches, [kind, STEPS], VALUES)
        if got is None:
            return
        values, entry, number, group, gk, gh = got
        begin, ks, hs, n = {}, [], [], 0
        for blob in (blob for batch in others for blob in batch.column(2)):
            one_k, one_h, *key = unpack(blob.as_py(), ["<i8"] * 4)
            if (key := (int(key[0][0]), int(key[1][0]))) not in begin:
                begin[key] = n
                n += len(one_k)
                ks.append(one_k)
                hs.append(one_h)
        at = np.array([begin[x] for x in zip(gk.tolist(), gh.tolist(), strict=True)])[group] + number
        k, h = np.concatenate(ks)[at], np.concatenate(hs)[at]
        order = np.lexsort((h, k))
        fresh = np.r_[True, (k[order][1:] != k[order][:-1]) | (h[order][1:] != h[order][:-1])]
        document = np.empty(len(k), np.int64)
        document[order] = np.cumsum(fresh) - 1
        head = order[fresh]
        of = document[entry]
        turn = np.argsort(of, kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(of, minlength=len(head)))] * values.dtype.itemsize
        values = values[turn]
        for i in range(0, len(head), 4096):
            j = min(len(head), i + 4096)
            part = values[ends[i] // values.dtype.itemsize : ends[j] // values.dtype.itemsize]
            found = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((ends[i : j + 1] - ends[i]).astype(np.int32).tobytes()), pa.py_buffer(part.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(k[head[i:j]]), pa.array(h[head[i:j]]), found], names=["k", "h", "found"])

    return run


def listed(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Packed values of a column, and their offsets by row; null counts as none."""
    data, offsets = A.buffer(column)
    return np.frombuffer(data.tobytes(), kind), offsets // np.dtype(kind).itemsize


def candidates(how: Symbols, keys: np.ndarray, settle):
    """Pass 2, map side: windows of shared stretches that no window of the batch settles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h = columns(batch)
            data, offsets = A.buffer(A.rows(batch, "text"))
            flags, by_flag = listed(A.rows(batch, "found"), "<u4")
            flag_row = np.repeat(np.arange(len(k)), np.diff(by_flag))
            wanted = np.sort((flag_row << 32) | flags)
            for span in A.slices(offsets, GROUP_BYTES):
                yield from one(k, h, data, offsets, wanted, *span)

    def one(k, h, data, offsets, wanted, low, high) -> Iterator[pa.RecordBatch]:
        docs, got = Group(k[low:high], h[low:high]), []
        for i, j in A.slices(offsets[low : high + 1]):
            i, j = i + low, j + low
            base = offsets[i]
            symbols, by, bounds = how.read(data[base : offsets[j]], offsets[i : j + 1] - base)
            first, count, pivot, row = stretches(symbols, by, how)
            mark = ((row + i) << 32) | (first - by[row])
            at = np.searchsorted(wanted, mark)
            keep = np.r_[wanted, -1][at] == mark
            first, count, pivot, row = first[keep], count[keep], pivot[keep], row[keep]
            if bounds is None:
                low_byte, high_byte = first, first + count + how.length - 1
            else:
                low_byte, high_byte = bounds[0][first], bounds[1][first + count + how.length - 2]
            got.append((count, pivot, row + (i - low), first - by[row], low_byte + base, high_byte - low_byte))
        count, pivot, row, start, at, size = (np.concatenate(x) for x in zip(*got, strict=True))
        if not len(count):
            return
        block, mine, again, *source, whole = looked_into(how, settle if how.early else unsettled, data[spread(at, size)], size, count, start, docs.k[row])
        yield docs.keys_of_rows(keys)
        yield docs.settled(*all_factors(how, block, mine, again, source, whole, row, start, count, docs.k[row]), keys)
        left = np.flatnonzero(~again)
        if not len(left):
            return
        of = mine[block.of[left]]
        pivot, of, each, place = pivot[of], row[of], block.start[left], block.at[left]
        head = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (each[1:] != each[:-1] + 1) | (pivot[1:] != pivot[:-1])])
        count = np.diff(np.r_[head, len(of)])
        low_byte = block.begin[place[head]]
        size = block.end[place[head] + count + how.length - 2] - low_byte

        def make(at: np.ndarray) -> bytes:
            used, where = np.unique(of[head[at]], return_inverse=True)
            sizes = size[at].astype("<u4") if how.words else np.zeros(0, "<u4")  # else they follow from the counts
            return pack(count[at].astype("<u4"), steps(where), steps(each[head[at]]), sizes, block.body[spread(low_byte[at], size[at])], far_steps(docs.k[used]), *docs.documents(used))

        yield dealt((A.mix(pivot[head]) % A.U(len(keys))).astype(np.int64), keys, make)

    return run


def resolved(how: Symbols, keys: np.ndarray, settle):
    """Pass 2, reduce side: windows that repeat an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, others = gather(batches, ["<u4", STEPS, STEPS, "<u4", "u1", FAR_STEPS])
        yield from others
        if got is None:
            return
        count, row, start, size, body, k, *docs = got
        size = size if how.words else count + np.uint32(how.length - 1)
        key = k[row]
        block, mine, again, *source, whole = looked_into(how, settle, body, size, count, start, key)
        yield settled(*all_factors(how, block, mine, again, source, whole, row, start, count, key), *docs, keys)

    return run


def once(found: DataFrame) -> DataFrame:
    """One record a document: rows of equal id and text may stand in several groups, and each has the whole result."""
    return found.groupBy("k", "h").agg(F.min("found").alias("found"))


def repeats(docs: DataFrame, how: Symbols, settle, finish, schema: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Applies finish to each document with the windows that settle marked.

    settle(block) returns a mask of the windows that repeat an earlier one, and
    if it can the document and place of that one. A null id counts as the
    greatest. Rows that share an id and a text share their results.
    """
    key, body = named(id_column).cast("long"), F.coalesce(named(text).cast("string"), F.lit(""))
    base = docs.select(F.coalesce(key, F.lit(LAST)).alias("k"), F.xxhash64(body, key.isNull()).alias("h"), key.isNull().alias("none"), body.alias("text"))
    n = tasks_for(base, TASK_BYTES if how.early else TASK_BYTES // 2)  # windows that batches did not settle meet there
    keys = murmur_keys(n)
    kind = FACTOR if how.within else SPAN
    first = arrow_map(base, pivots(how, keys), RECORD).repartition(n, "bucket")
    found = once(arrow_map(arrow_map(first, shared_pivots(how, keys), RECORD).repartition(n, "bucket"), by_document("<u4"), FOUND))
    second = arrow_map(base.join(found, ["k", "h"]), candidates(how, keys, settle), RECORD).repartition(n, "bucket")
    marked = once(arrow_map(arrow_map(second, resolved(how, keys, settle), RECORD).repartition(n, "bucket"), by_document(kind), FOUND))
    out = arrow_map(base.join(marked, ["k", "h"], "left"), finish, f"k long, none boolean, {schema}")
    return out.withColumn("k", F.when(~F.col("none"), F.col("k"))).drop("none").withColumnRenamed("k", id_column)


def covered(offsets: np.ndarray, spans: np.ndarray, by_span: np.ndarray, i: int, j: int, length: int) -> np.ndarray:
    """Which symbols of rows i to j, whose symbols start at `offsets`, lie in a marked window."""
    n = int(offsets[-1])
    some = spans[by_span[i] : by_span[j]]
    row = np.repeat(np.arange(j - i), np.diff(by_span[i : j + 1]))
    begin = offsets[row] + some["start"]
    edge = np.bincount(begin, minlength=n + 1) - np.bincount(begin + some["count"] + (length - 1), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][offsets])
