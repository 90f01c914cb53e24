import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from lamina.llm import chosenpath as C


def brute(rows):
    """class and links of each (id, text)."""
    sets = []
    for _, t in rows:
        w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up, links = list(range(len(rows))), collections.Counter()

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                up[b] = a
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), rows[i][0]), rows[i][0])
    return {rows[i][0]: (least[top(i)], links[i]) for i in range(len(rows))}


def near_copies(n, r):
    words = [f"w{r.randint(0, 9999)}" for _ in range(150)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(150)] = f"e{r.randint(0, 99999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [256, 4])
def test_classes_and_links(spark, docs, monkeypatch, small):
    import random

    r = random.Random(small)
    monkeypatch.setattr(C, "SMALL", small)
    monkeypatch.setattr(C, "BLOCK", small * 4)
    texts = [x.text for x in docs.collect()] + near_copies(40, r) + near_copies(9, r)
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.class_id, x.n_links) for x in C.classes(frame).collect()}
    assert got == brute(rows)


def test_representatives(spark, docs):
    got = C.representatives(docs)
    assert got.columns == docs.columns
    ids = {r.doc_id for r in got.collect()}
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert ids == {c for c, _ in want.values()}


def test_edges(empty, doubled):
    assert C.classes(empty).count() == 0 and C.representatives(empty).count() == 0
    assert C.classes(doubled).count() == doubled.count()
    assert C.representatives(doubled).count() == 4  # repeated texts once, the other text, the one without text, the last


def test_components(spark):
    edges = [(b"%d" % a, b"%d" % b) for a, b in [(2, 1), (3, 2), (4, 3), (9, 8), (7, 9), (5, 5)]]
    got = {bytes(r.node): bytes(r.root) for r in C.components(spark.createDataFrame(edges, "u binary, v binary")).collect()}
    assert got == {b"1": b"1", b"2": b"1", b"3": b"1", b"4": b"1", b"7": b"7", b"8": b"7", b"9": b"7"}


def test_paths_survive_descents():
    """Links at 0.8 whose buckets all descend keep the stated recall."""
    r, n = np.random.default_rng(3), 20000
    one = r.integers(1, 256, (n, C.BINS)).astype(np.uint8)
    two = np.where(r.random(one.shape) < 0.8, one, one % 255 + 1).astype(np.uint8)
    path, of = np.arange(n) + 1, np.arange(n)
    for level in range(2, C.DEPTH + 1):
        made = []
        for sketch in (one, two):
            batch = pa.RecordBatch.from_arrays([pa.array(path), pa.array([int(i).to_bytes(4, "big") for i in of], pa.binary()), pa.array([s.tobytes() for s in sketch[of]], pa.binary())], names=["path", "x", "sketch"])
            out = pa.Table.from_batches(list(C.descend(level)(iter([batch]))))
            made.append(set(zip(out["path"].to_pylist(), out["x"].to_pylist(), strict=True)))
        both = sorted(made[0] & made[1])
        path, of = np.array([p for p, _ in both]), np.array([int.from_bytes(x, "big") for _, x in both])
    assert (1 - 0.8 * len(set(of.tolist())) / n) ** C.runs_for(C.RECALL, 0.8) <= 1.2 * (1 - C.RECALL)


def test_recall_on_a_table(spark):
    """Links of every document whose id is divisible by 20, against all rows by brute force."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    sets, holders = {}, collections.defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        for x in sets[i]:
            holders[x].append(i)
    got = {r.doc_id: r.n_links for r in C.classes(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("doc_id % 20 = 0").collect()}
    want = {}
    for i in got:
        common = collections.Counter(j for x in sets[i] for j in holders[x] if j != i)
        want[i] = sum(5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n) for j, n in common.items())
    assert all(got[i] <= want[i] for i in got)
    assert sum(want.values()) > 200 and sum(got.values()) >= 0.999 * sum(want.values())
