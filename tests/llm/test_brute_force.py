"""Plain Python versions of what SQL cannot express, on the driver's tables."""

import collections
import math
import re

import numpy as np
import regex
import xxhash

from lamina.llm import _arrow as A
from lamina.llm import licenses, omh, pii, toxicity

SF = "/root/testdata/sf0.01"


def texts_of(spark, sf=SF):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


# --- licences -------------------------------------------------------------------


def test_licence_columns(spark):
    """Words, places of the phrases, and templates that stand in a text word for word."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = texts_of(spark)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    rows = {name: word.findall(t.translate(lower)) for name, t in licenses.TEMPLATES.items()}
    seen = 0
    for r in licenses.scan(docs).collect():
        w = word.findall(texts[r.doc_id].translate(lower))
        places = {i: label for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p}
        starts = sorted(places)
        assert (r.n_words, r.n_base) == (len(w), len(starts))
        assert (r.first_word, r.last_word) == ((starts[0], starts[-1]) if starts else (None, None))
        assert r.base_labels == ",".join(sorted(set(places.values())))
        whole = {name for name, t in rows.items() if any(w[i : i + len(t)] == t for i in range(len(w) - len(t) + 1))}
        labels = set(r.labels.split(",")) - {""}
        assert whole | set(places.values()) <= labels and 0 <= r.score <= 1 and (r.score >= 0.75 or not labels)
        seen += bool(whole)
        for s in r.spans:  # spans hold what they claim, in order
            assert 0 <= s["first"] <= s["last"] < len(w) and s["covered"] >= 0.75
    assert seen > 5


def test_short_and_repeated_templates(spark):
    """Templates of one and two words, and a chain that goes on from the first of many matches."""
    templates = {"one": "zlib", "two": "MIT License", "long": " ".join(f"t{i}" for i in range(12)), "echo": "red red red blue green red blue"}
    noise = "t0 t1 t2 t3 x " * 60
    rows = [(1, "some MIT License here"), (2, "with zlib"), (3, "t0 t1 t2 t3 t4 t5 x x t6 t7 t8 t9 t10 t11"), (4, noise + "t0 t1 t2 t3 t4 t5 y t6 t7 t8 t9 t10 t11"), (5, "MIT is a License"), (6, "zlibs"), (7, "red red red blue green red blue")]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates, {}).collect()}
    assert got == {1: "two", 2: "one", 3: "long", 4: "long", 5: "", 6: "", 7: "echo"}


def test_templates_of_a_folder(spark, tmp_path):
    (tmp_path / "own-1.0.txt").write_text("you may use this thing\nas you like")
    (tmp_path / "other").write_text("no use without asking us first")
    templates = licenses.templates_from(spark, str(tmp_path))
    assert templates == {"own-1.0": "you may use this thing\nas you like", "other": "no use without asking us first"}
    rows = [(1, "Here You may use this THING as you like."), (2, "nothing")]
    assert {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()} == {1: "own-1.0", 2: ""}


# --- fingerprints -----------------------------------------------------------------


def chained(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v, seed=seed)
    return seed


def signature(text, k=2, bins=32, width=2):
    core = text.strip(" \t\n\x0b\f\r")
    w = re.split(r"[\x20\x09-\x0D]+", core) if core else []
    if len(core) > 40 * len(w):
        w, k = list(core), 8
    seen, found = collections.Counter(), collections.defaultdict(list)
    for i in range(max(1, len(w) - k + 1) if w else 0):
        code = chained([x.encode() for x in w[i : i + k]]) >> 28
        h = chained([code.to_bytes(8, "little"), seen[code].to_bytes(4, "little")])
        seen[code] += 1
        found[(h >> 40) % bins].append((h & ((1 << 30) - 1), i))
    out = [None] * bins
    for b, held in found.items():
        least = sorted(sorted(held)[:width], key=lambda x: x[1])
        out[b] = chained([c.to_bytes(8, "little") for c, _ in least]) & ((1 << 31) - 1)
    return out


def likeness(a, b):
    some = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
    return sum(x == y for x, y in some) / len(some) if some else 1.0


def test_fingerprints(spark):
    """Signatures, their text form and likenesses of every document, its edit and the next document."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    glued = spark.createDataFrame([(10**9, "q" * 400), (10**9 + 1, "".join(chr(97 + i * i % 26) for i in range(500))), (10**9 + 2, "one"), (10**9 + 3, None)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(glued)
    texts = sorted((r.doc_id, r.text or "") for r in rows.collect())
    written = lambda s: "".join("-" if x is None else f"{x:08x}" for x in s)
    got = {r.doc_id: r for r in omh.compared(rows).collect()}
    for (i, t), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(t) // 2
        own, edit, other = signature(t), signature(t[: len(t) - half] + after[:half]), signature(after)
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (written(own), written(edit)), i
        assert r.near_edited == likeness(own, edit) and r.near_next == likeness(own, other)
    assert 0 < got[10**9 + 1].near_edited < 1


# --- toxicity -------------------------------------------------------------------------


def discount(n):
    one, two = sum(x == 1 for x in n), sum(x == 2 for x in n)
    return one / (one + 2 * two) if one and two else 0.75


class Plain:
    """One class's interpolated Kneser-Ney model: bigrams, words, stems of 6 and 4 characters, corpus counts."""

    def __init__(self, texts, vocabulary, shared, total):
        self.gram, self.follow, self.kinds = collections.Counter(), collections.Counter(), collections.Counter()
        for w in texts:
            for v, x in zip(["", *w], w, strict=False):
                self.gram[v, x] += 1
        for (v, _), n in self.gram.items():
            self.follow[v] += n
            self.kinds[v] += 1
        self.d = discount(self.gram.values())
        word = collections.Counter(x for _, x in self.gram)
        six = collections.Counter(x[:6] for x in word)
        four = collections.Counter(x[:4] for x in word)
        self.levels, self.shared, self.total = [word, six, four], shared, total
        self.ds = [discount(c.values()) for c in self.levels]

    def left(self, i):
        return self.ds[i] * len(self.levels[i]) / sum(self.levels[i].values())

    def share(self, x, i):
        """Of an expression that its shared counts hold."""
        if i == 3:
            return self.shared[2][x] / self.total
        c = self.levels[i]
        if i < 2:
            up = x[: (6, 4)[i]]
            parent = self.share(up, i + 1) * self.shared[i][x] / self.shared[i + 1][up]
        else:
            parent = self.share(x, 3)
        return max(c[x] - self.ds[i], 0) / sum(c.values()) + self.left(i) * parent

    def after(self, v, x):
        if v not in self.follow:
            return self.share(x, 0)
        return max(self.gram[v, x] - self.d, 0) / self.follow[v] + self.d * self.kinds[v] / self.follow[v] * self.share(x, 0)


def test_kneser_ney(spark):
    """Log-ratios of every word, by itself and after the one before it, against plain Python."""
    word = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    read = lambda t: word.findall((t or "").translate(lower))
    texts = texts_of(spark, "/root/testdata/sf0.001")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    train = spark.createDataFrame([(int(labels[i]), texts[i]) for i in sorted(labels)], "toxic int, text string").repartition(2)
    corpus = spark.createDataFrame([(t,) for t in texts.values()], "text string")
    model = toxicity.fit_models(train, corpus)
    rows = {c: [read(texts[i]) for i in labels if labels[i] == c] for c in (0, 1)}
    vocabulary = {x for c in rows.values() for w in c for x in w}
    whole = collections.Counter(x for t in texts.values() for x in read(t))
    stems = {n: collections.Counter() for n in (6, 4)}
    for x, n in whole.items():
        for size, held in stems.items():
            held[x[:size]] += n
    shared, total = [whole, stems[6], stems[4]], sum(whole.values())
    bad, good = (Plain(rows[c], vocabulary, shared, total) for c in (1, 0))
    some = list(texts.values())[:60] + ["unseen words zzzzzz entirely", " ".join(sorted(vocabulary)[:40])]
    data = np.frombuffer("".join(some).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in some])]
    alone, each, by = model.ratios(data, offsets)
    checked = 0
    for i, t in enumerate(some):
        w = read(t)
        assert by[i + 1] - by[i] == len(w)
        for j, (v, x) in enumerate(zip(["", *w], w, strict=False)):
            at = by[i] + j
            if x in vocabulary:
                assert math.isclose(alone[at], math.log(bad.share(x, 0) / good.share(x, 0)), rel_tol=1e-3, abs_tol=1e-4), (v, x)
                want = math.log(bad.after(v, x) / good.after(v, x))
                assert math.isclose(each[at], want, rel_tol=1e-3, abs_tol=1e-4), (v, x)
                checked += 1
            elif x[:6] in bad.levels[1] | good.levels[1]:
                want = math.log(bad.left(0) / good.left(0)) + math.log(bad.share(x[:6], 1) / good.share(x[:6], 1))
                assert math.isclose(alone[at], want, rel_tol=1e-3, abs_tol=1e-4)
    assert checked > 1000
    assert A.U(0) in model.history[0]  # texts start from somewhere


# --- surrogates -------------------------------------------------------------------


def test_surrogates_on_a_table(spark):
    """Between mentions nothing changes but repeats of names; equal mentions have one surrogate, different ones different ones."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    after = {r.doc_id: r for r in pii.replace(rows, "k", count="n").collect()}
    every = regex.compile(pii.EVERY)
    made, back, changed = {}, {}, 0
    for i, t in texts_of(spark).items():
        mentions = list(every.finditer(t))
        new = after[i].text or ""
        assert after[i].n == len(mentions), i
        if not mentions:
            assert new == t
            continue
        changed += 1
        names = [m[0] for m in mentions if regex.fullmatch(r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?", m[0]) and not regex.search(r"[0-9]", m[0])]
        pieces = every.split(t)
        at = 0
        for j, piece in enumerate(pieces):
            if not any(n.split(" ")[-1] in piece for n in names):
                assert new.startswith(piece, at), (i, j)
            if j < len(mentions) and not names:
                at += len(piece)
                value = mentions[j][0]
                stop = new.find(pieces[j + 1], at) if pieces[j + 1] else len(new)
                fake = new[at:stop] if stop > at else new[at:]
                assert fake != value
                if pieces[j + 1] and regex.search(r"\s", pieces[j + 1][0]):
                    folded = regex.sub(r"[^0-9A-Za-z]", "", value).lower()
                    assert made.setdefault(folded, regex.sub(r"[^0-9A-Za-z]", "", fake).lower()) == regex.sub(r"[^0-9A-Za-z]", "", fake).lower() or "@" in value
                    back.setdefault(made[folded], set()).add(folded)
                at += len(fake)
            else:
                break
    assert changed > 20 and len(made) > 10 and all(len(x) == 1 for x in back.values())
