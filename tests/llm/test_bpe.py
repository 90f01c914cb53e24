import random

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lamina.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read()), Tokenizer.from_file(PATH)


def check(pair, texts):
    ours, theirs = pair
    ids = ours.encode(texts)
    for text, x, e in zip(texts, ids, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(memoryview(x).cast("I")) == e.ids
        assert ours.decode(x) == theirs.decode(e.ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    with open(PATH, encoding="utf-8") as f:
        test_any_text.v = getattr(test_any_text, "v", None) or bpe.Vocabulary(f.read())
    test_any_text.t = getattr(test_any_text, "t", None) or Tokenizer.from_file(PATH)
    check((test_any_text.v, test_any_text.t), texts)


def test_hard_words(pair, monkeypatch):
    r = random.Random(2)
    parts = ["the", "ing", " Th", "tion", "  ", "er", "XY", "zz", "'s", "1", "23", "<|endoftext|>", "\n", "é", "中"]
    texts = ["", "<|endoftext|>", "a" * 5000, " " * 3000, "ab" * 2000] + ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(800)]
    check(pair, texts)
    monkeypatch.setattr(bpe, "RUN", 7)
    monkeypatch.setattr(bpe, "CACHE", 50)
    check(pair, texts[5:200])


def test_documents(pair, docs, empty, doubled):
    got = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    for r in docs.collect():
        ids, text = got[r.doc_id]
        assert text == (r.text or "") and list(memoryview(ids).cast("I")) == pair[1].encode(r.text or "", add_special_tokens=False).ids
    assert bpe.digests(empty, PATH).count() == 0 and bpe.digests(doubled, PATH).count() == doubled.count()


def test_round_trip(docs):
    """One pass gives what encode() and decode() give, and workers tell tokenizer files apart."""
    two = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.decode(bpe.encode(docs, PATH), PATH).collect()}
    assert {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.round_trip(docs, PATH).collect()} == two


def test_workers_serve_the_file_they_are_given(pair):
    class Shared:
        def __init__(self, value):
            self.value = value

    with open(PATH, encoding="utf-8") as f:
        text = f.read()
    one = bpe._vocabulary(Shared(("a", text)))
    assert bpe._vocabulary(Shared(("a", text))) is one and bpe._vocabulary(Shared(("b", text))) is not one
