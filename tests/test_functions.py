import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina import config
from lamina.functions import documents, images, rng, schedules, text, vectors


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_counter_generator_vectors():
    for (seed, draw, stream), value in {(0, 0, 0): 0xE220A8397B1DCDAF, (7, 1, 2): 0xF1DDD83E06A77747, (7, 1000000, 5): 0x94D77E8106A636AE}.items():
        assert int(rng.values(seed, np.array([draw]), stream)[0]) == value
    draws = np.arange(8)
    assert rng.indices(rng.values(7, draws, 3), np.full(8, 37)).tolist() == [33, 8, 29, 23, 2, 18, 29, 18]


def test_weighted_choice(spark):
    assert rng.shares({"b": 0.5, "a": 0.5, "c": 0}) == [("a", 0.5), ("b", 1.0)]
    with pytest.raises(ValueError):
        rng.shares({"a": 0.5})
    assert one(spark, rng.choice(F.lit(0.5), {"b": 0.5, "a": 0.5}))[0] == "b"


def test_names(spark):
    row = one(
        spark,
        text.concept_id(F.lit("Epithelial-stromal / interface")),
        text.stem(F.lit("/a/b/S.1.svs")),
        text.slide_of_file(F.lit("/a/b/S.1.svs")),
        text.without_patch_suffix(F.lit("x_patches")),
        text.with_extension(F.lit("x")),
        text.cluster_key(F.lit(5), F.lit(3)),
        text.filled(F.lit("a {} b"), F.lit("c")),
        text.filled(F.lit("a CLASSNAME"), F.lit("c")),
        text.filled(F.lit("a"), F.lit("c")),
        text.patch_size_level0(F.lit(None).cast("int"), F.lit(1), F.lit(5), F.lit(2)),
    )
    assert list(row) == ["epithelial_stromal_interface", "S.1", "S", "x", "x.svs", "5x:3", "a c b", "a c", "a c", 2]


def test_vectors(spark):
    v = F.array(*map(F.lit, (3.0, 4.0)))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    row = one(spark, vectors.norm(v), vectors.normalized(v), vectors.normalized(zero), vectors.squared_distance(v, zero), vectors.finite(F.array(F.lit(float("nan")))), vectors.is_unit(vectors.normalized(v)), vectors.cosine_distance(v, v))
    assert row[0] == 5 and row[1] == [0.6, 0.8] and row[2] == [0, 0] and row[3] == 25 and row[4] is False and row[5] is True and abs(row[6]) < 1e-12


def test_prompts_and_redaction(spark):
    concepts = spark.createDataFrame([("positive", "architecture", "Gland"), ("positive", "architecture", "gland")], "polarity string, category string, concept string")
    got = text.prompts(concepts, ["a CLASSNAME", "x"]).orderBy("prompt").collect()
    assert [r.prompt for r in got] == ["a Gland", "a gland", "x Gland", "x gland"]
    docs = spark.createDataFrame([(1, "mail b@x.org and a@x.org"), (2, "again b@x.org"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in text.redacted(docs).collect()}
    assert got == {1: "mail PRIVATE_0002 and PRIVATE_0001", 2: "again PRIVATE_0002", 3: None}


def test_numbered(spark):
    rows = spark.createDataFrame([("b",), ("aa",), ("ab",), ("c",)], "s string")
    assert {r.s: r.n for r in text.numbered(rows, "s", "n").collect()} == {"aa": 0, "ab": 1, "b": 2, "c": 3}


def test_masks_and_hashes(spark):
    flags = {"random": F.lit(True), "rare_clean": F.lit(True), "bridge": F.lit(False)}
    row = one(spark, documents.mask(flags), documents.memberships(flags))
    assert row[0] == 9 and row[1] == ["random", "rare_clean"]
    assert documents.canonical_hash({"b": 1, "a": 2}) == documents.canonical_hash({"a": 2, "b": 1})
    with pytest.raises(ValueError):
        documents.canonical_hash(math.nan)
    assert documents.attribute([b"x"]) == "x" and documents.attribute(math.inf) == "inf"


def test_pixels(spark):
    row = one(spark, images.hsv(F.lit(0xFF0000)), images.hsv(F.lit(0x0000FF)), images.hsv(F.lit(0)), images.coverage(F.array(F.lit(0x8000FF), F.lit(0))))
    assert tuple(row[0]) == (0, 255, 255) and tuple(row[1]) == (120, 255, 255) and tuple(row[2]) == (0, 0, 0) and row[3] == 0.5


def test_schedules(spark):
    rows = spark.range(12).select(schedules.cosine(F.col("id"), 1.0, 0.0, 10, warmup=2, freeze=1), schedules.linear(F.col("id"), 1.0, 0.0, 10)).collect()
    assert rows[0][0] == 0 and rows[3][0] == 1 and rows[11][0] == 0 and rows[0][1] == 1


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"audit": {"seed": 9}, "wsi_path": "x/y"}')
    got = config.load(str(p))
    assert got["audit"]["seed"] == 9 and got["audit"]["tiles_per_slide"] == 2 and got["wsi_path"] == str(tmp_path / "x/y")
    with pytest.raises(ValueError):
        config.load(over={"semantic": {"weights": {"architecture": 0.9}}})
    assert config.magnification_folders(["5=a", "10=b", "20x=c", "40=d"])[20] == "c"
    with pytest.raises(ValueError):
        config.magnification_folders(["5=a"])


def test_redaction_of_repeated_keys(spark):
    """Places belong to texts: rows of one key, or without one, keep their own tokens."""
    rows = [(1, "a /home/x/one b"), (1, "see /data/y/two and /home/x/one"), (None, "mail me@site.org"), (None, None), (2, "plain"), (1, "a /home/x/one b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in text.redacted(docs).collect()), key=str)
    one, two, mail = "PRIVATE_0002", "PRIVATE_0001", "PRIVATE_0003"
    assert got == sorted([(1, f"a {one} b"), (1, f"see {two} and {one}"), (None, f"mail {mail}"), (None, None), (2, "plain"), (1, f"a {one} b")], key=str)
    found = spark.createDataFrame([("/home/x/one",), ("/data/y/two",), ("me@site.org",)], "value string")
    back = text.restored(text.redacted(docs), text.redaction_map(found))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(rows, key=str)


def test_numbered_by_sampled_ranges(spark):
    """Values of one prefix are not one range."""
    values = [f"TCGA-{i * 7919 % 10007:05d}" for i in range(10000)]
    rows = spark.createDataFrame([(v,) for v in values], "s string").repartition(5)
    got = text.numbered(rows, "s", "n", rows=500)
    assert {r.s: r.n for r in got.collect()} == {v: i for i, v in enumerate(sorted(values))}
    assert rows.select(text.range_of(rows, "s", 500).alias("g")).groupBy("g").count().agg(F.max("count")).first()[0] < 2000
    whole = spark.range(5000).withColumn("n", -F.col("id"))
    assert text.numbered(whole, "n", "at", rows=300).where(F.col("at") != 4999 + F.col("n")).count() == 0
