"""Every operator on columns of any name and type, repeated rows, null ids and very long texts."""

import pytest
from pyspark.sql import types as T

from lamina.llm import bpe, chosenpath, mixing, pii, toxicity
from lamina.llm.queries import tokenizer_path

ODD = ["a b", "a.b", "_copies", "_copy", "row", "k", "h", "x", "n", "id", "`q`", "size"]


@pytest.fixture(scope="module")
def odd(spark):
    """Two rows of one id and text, two of one id and other texts, two without id, a map column, names that clash or need quotes."""
    texts = ["mail j.doe@site.org and Mr John Smith", "mail j.doe@site.org and Mr John Smith", "one text of some words", "another text of more words", "no id is here", "no id is there either", None, ""]
    ids = [1, 1, 2, 2, None, None, 7, 8]
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), *[T.StructField(c, T.StringType()) for c in ODD], T.StructField("map", T.MapType(T.StringType(), T.IntegerType()))]
    rows = [(i, t, "s" if j % 2 else None, *[f"{c}{j}" for c in ODD], {"m": j}) for j, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, T.StructType(fields)).repartition(2).persist()


def untouched(frame, docs, text=True):
    """Each row's own columns still belong together."""
    assert frame.columns == docs.columns and frame.schema == docs.schema
    was = {r["map"]["m"]: r for r in docs.collect()}
    rows = frame.collect()
    for r in rows:
        same = was[r["map"]["m"]]
        assert all(r[c] == same[c] for c in docs.columns if c != "map" and (text or c != "text"))
    return [r["map"]["m"] for r in rows]


def test_toxicity(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int")
    untouched(toxicity.accepted(odd, labels), odd)
    none = toxicity.accepted(odd, labels.limit(0))
    assert sorted(untouched(none, odd)) == list(range(8))


def test_representatives(odd):
    kept = untouched(chosenpath.representatives(odd), odd)
    assert len(kept) == 7 and len({0, 1} & set(kept)) == 1


def test_surrogates(odd):
    out = pii.replace(odd, "k")
    assert sorted(untouched(out, odd, False)) == list(range(8))
    assert not any("Smith" in (r.text or "") for r in out.collect())


def test_mix(odd):
    kept = untouched(mixing.mix(odd), odd)
    assert all(kept.count(i) <= 2 for i in kept) and not {6, 7} & set(kept) and {4, 5} & set(kept)


def test_bpe(odd):
    out = bpe.encode(odd, tokenizer_path(), keep=odd.columns)
    assert out.columns == [*odd.columns, "ids"] and sorted(r["map"]["m"] for r in bpe.decode(out, tokenizer_path()).collect()) == list(range(8))
