import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from lamina.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= kept and ids
        kept = ids
    out = P.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == docs.count()
    for r in out:
        assert r.n_tokens == len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_names():
    assert sorted(queries.queries()) == sorted(f for f in queries.queries() if f.startswith("op")) and len(queries.queries()) == 10
    assert set(queries.oracle_sql()) <= set(queries.queries())
