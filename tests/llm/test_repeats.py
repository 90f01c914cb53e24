import hashlib
import re

import numpy as np
import pytest

from lamina.llm import _arrow as A
from lamina.llm import _repeats as R
from lamina.llm import substring, suffix

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def words_left(rows, length=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = SPACE.findall((t or "").encode())
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            if key in seen:
                gone[p : p + length] = True
            seen.add(key)
        out[i] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode("utf-8", "replace"))
    return out


def bytes_left(rows, length=50):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone, mine = np.zeros(len(b), bool), set()
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            mine.add(b[p : p + length])
        seen |= mine
        runs = int(np.sum(gone & ~np.r_[False, gone[:-1]])) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("group", [1 << 21, 2000])
def test_word_windows(spark, docs, monkeypatch, group):
    monkeypatch.setattr(R, "GROUP_BYTES", group)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup(docs).collect()}
    assert got == words_left([(r.doc_id, r.text) for r in docs.collect()])


def test_factors_name_their_source(docs):
    texts = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    n = 0
    for r in substring.dedup(docs).collect():
        for f in r.factors:
            n += 1
            a = texts[r.doc_id][f.start : f.start + f.length]
            assert len(a) >= 20 and a == texts[f.source_id][f.source_start : f.source_start + f.length]
            assert (f.source_id, f.source_start) < (r.doc_id, f.start)
    assert n > 5


def test_byte_windows(docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix.dedup(docs).collect()}
    assert got == bytes_left([(r.doc_id, r.text) for r in docs.collect()])


def test_repeated_rows_in_several_groups(docs, monkeypatch):
    """Every row of a document, whichever group it is in, has the document's whole result, and just once."""
    monkeypatch.setattr(R, "GROUP_BYTES", 500)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    twice = docs.union(docs).union(docs).repartition(5)
    words = [(r.doc_id, (r.n_words, r.n_removed, r.kept)) for r in substring.dedup(twice).collect()]
    assert sorted(words) == sorted(3 * list(words_left(rows).items()))
    found = [(r.doc_id, (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))) for r in suffix.dedup(twice).collect()]
    assert sorted(found) == sorted(3 * list(bytes_left(rows).items()))


def test_packed_columns():
    ids = np.array([-5, 3, R.LAST, -(1 << 63), 7], np.int64)
    places = np.array([9, 2, 2, (1 << 31) + 5], np.int64)
    docs = R.Group(ids, ids[::-1].copy())
    used = np.array([1, 4])
    got = R.unpack(R.pack(ids, R.steps(places), R.far_steps(ids), *docs.documents(used)), ["<i8", R.STEPS, R.FAR_STEPS, *R.DOCUMENTS])
    assert [x.tolist() for x in got[:5]] == [ids.tolist(), places.tolist(), ids.tolist(), [1, 4], [0, 0]]
    assert [x.tolist() for x in got[5:]] == [x.tolist() for x in R.Group(ids.copy(), ids[::-1].copy()).key]
    assert docs.key[1] != R.Group(ids, ids).key[1]


def test_digests(docs):
    got = {r.doc_id: r.kept_sha256 for r in suffix.digests(docs).collect()}
    assert got == {i: hashlib.sha256(x[3]).hexdigest() for i, x in bytes_left([(r.doc_id, r.text) for r in docs.collect()]).items()}


def test_edges(empty, doubled):
    assert substring.digests(empty).count() == 0 and suffix.digests(empty).count() == 0
    assert suffix.digests(doubled).count() == substring.digests(doubled).count() == doubled.count()
    kept = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix.digests(doubled).collect()}
    assert kept[1, 168] == 0 and kept[None, 168] == 168  # no id comes last


def test_levels():
    r = np.random.default_rng(0)
    index, seen = suffix.Levels(), set()
    for _ in range(40):
        keys = np.unique(r.integers(0, 3000, r.integers(1, 200)).astype(np.uint64))
        assert index.seen(keys).tolist() == [int(k) in seen for k in keys]
        index.add(np.array([k for k in keys if int(k) not in seen], np.uint64))
        seen |= set(map(int, keys))
        sizes = [len(x) for x in index.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def test_rolling_hashes():
    data = np.random.default_rng(1).integers(0, 4, 500).astype(np.uint8)
    for n in (1, 5, 20, 50):
        h = A.roll(A.BYTE_CODE[data], n)
        texts = [bytes(data[i : i + n]) for i in range(len(data) - n + 1)]
        assert len(h) == len(texts) and len(set(h.tolist())) == len(set(texts))
        assert all((h[i] == h[0]) == (texts[i] == texts[0]) for i in range(len(texts)))
    x = np.random.default_rng(2).integers(0, 1000, 300).astype(np.uint64)
    for w in (1, 2, 13, 35):
        assert A.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]


def test_partition_keys(spark):
    from pyspark.sql import functions as F

    keys = R.murmur_keys(13)
    got = spark.createDataFrame([(int(k),) for k in keys], "k int").select(F.pmod(F.hash("k"), F.lit(13))).collect()
    assert [r[0] for r in got] == list(range(13))


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_hash_alike_by_construction(spark):
    """A polynomial hash modulo 2**64 cannot tell these words apart, whatever its multiplier."""
    a = thue_morse(1024)
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{a} {tail}"), (2, f"{a.translate(str.maketrans('ab', 'ba'))} {tail}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substring.dedup(frame).collect()] == [0, 0]


@pytest.mark.parametrize("operator", [substring, suffix])
def test_hashes_only_choose_candidates(spark, monkeypatch, operator):
    """Even if all hashes of words or windows agree, only equal text is removed."""
    import random

    r = random.Random(4)
    words = [f"v{i}" for i in range(6)]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(8)]
    texts += [texts[0], texts[1][30:] + texts[2]]
    how = R.Symbols(20, 8, True, True) if operator is substring else R.Symbols(50, 16, False, False)
    parts = [t.encode() for t in texts]
    body = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(p) for p in parts])
    count = np.array([max(0, (len(p.split()) if how.words else len(p)) - how.length + 1) for p in parts])
    monkeypatch.setattr(A, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    monkeypatch.setattr(A, "roll", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    monkeypatch.setattr(suffix, "BATCH", 100)
    block = R.Block(how, body, size, count, np.zeros(len(parts), np.int64), np.arange(len(parts)))
    again = (substring.parsed if how.words else suffix.earlier_documents)(block)[0]
    rows = list(enumerate(texts))
    want = {i: x[1] for i, x in (words_left if how.words else bytes_left)(rows).items()}
    for i in range(len(texts)):
        n = len(parts[i].split()) if how.words else len(parts[i])
        gone = np.zeros(n, bool)
        for s in block.start[again & (block.of == i)]:
            gone[s : s + how.length] = True
        assert gone.sum() == want[i]


def test_very_long_texts(spark):
    """Texts beyond every slice, with and without blanks, that share passages."""
    import random

    r = random.Random(9)
    long = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(400_000))
    glued = "".join(chr(r.randint(97, 122)) for _ in range(600_000))
    rows = [(1, long), (2, glued), (3, "x " + long[1_000_000:1_200_000] + " y"), (4, "|" + glued[300_000:400_000] + "|"), (5, glued + " " + glued)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    words = {x.doc_id: (x.n_words, x.n_removed) for x in substring.dedup(frame).collect()}
    assert words[1] == (400_000, 0) and words[2] == (1, 0) and words[5] == (2, 0) and words[3][0] - words[3][1] in (2, 3, 4)
    got = {x.doc_id: (x.n_bytes, x.n_removed, len(x.spans)) for x in suffix.dedup(frame).collect()}
    assert got[1][1] == got[2][1] == 0 and got[3][1:] == (200_000, 1) and got[4][1:] == (100_000, 1) and got[5][1] == 1_200_000
