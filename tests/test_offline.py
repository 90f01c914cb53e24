import pytest
from pyspark.sql import functions as F

from lamina import config
from lamina.functions.documents import mask
from lamina.operators import relations
from lamina.plans import offline
from lamina.plans import proxy as P
from lamina.plans.manifest import ManifestError
from lamina.session import Storage

SF = "/root/testdata/sf0.001"


def test_eight_stages(spark, tmp_path):
    tiles = P.packed_rows(P.tiles(spark, SF)).persist()
    # each cluster of a magnification has its own vectors, and a distinct score
    vectors = tiles.withColumn("vec_id", F.col("packed_row_index") % 200).join(P.vectors(spark, SF).select("vec_id", "embedding"), "vec_id").select("magnification", "fine_cluster_id", "coarse_cluster_id", "vec_id", "embedding")
    inputs = offline.Inputs(tiles, vectors, P.concepts(spark, SF), facts={"tables": SF})
    cfg = config.load(over={"profile": "smoke", "coverage": {"min_tiles": 3, "min_patients": 2}})
    folder = str(tmp_path / "run")
    assert offline.run(spark, folder, inputs, cfg, last="statistics") == offline.STAGES[:4]
    assert offline.run(spark, folder, inputs, cfg) == offline.STAGES[4:]
    assert offline.run(spark, folder, inputs, cfg) == []
    import json

    report = json.loads((tmp_path / "run/validation_report.json").read_text())
    assert len(report) == 20 and all(r["passed"] for r in report), report
    assert json.loads((tmp_path / "run/manifest.json").read_text())["stages"]["validation"]["passed"] is True
    with pytest.raises(ManifestError):
        offline.run(spark, folder, inputs, config.load())
    masks = spark.read.parquet(f"{folder}/buckets")
    index = str(tmp_path / "index")
    a = offline.compiled(spark, index, tiles, masks, lambda: {"v": 1})
    b = offline.compiled(spark, index, tiles, masks, lambda: {"v": 1})
    states = iter([{"v": 1}, {"v": 2}])
    with pytest.raises(ManifestError, match="changed"):
        offline.compiled(spark, index, tiles, masks, lambda: next(states))
    # the composite has each cluster's own semantic scores
    own = spark.read.parquet(f"{folder}/semantic_summary").select("magnification", "fine_cluster_id", F.col("architecture_score").alias("own"))
    both = spark.read.parquet(f"{folder}/composite").join(own, ["magnification", "fine_cluster_id"])
    assert both.count() == own.count() and both.where("architecture_score <> own").count() == 0 and own.select("own").distinct().count() > 5
    eligible = tiles.join(masks.where("sampling_eligible"), ["magnification", "fine_cluster_id"], "left_semi")
    assert a == b and a["entries"] == eligible.count() > 0


def test_one_to_one(spark):
    from lamina.operators import buckets

    a = spark.createDataFrame([(1, 2), (2, 3)], "k int, v int")
    assert buckets.one_to_one(a, a.withColumnRenamed("v", "w"), ["k"]).count() == 2
    for b in (a.limit(1), a.unionByName(a), spark.createDataFrame([(1, 2), (3, 3)], "k int, v int")):
        with pytest.raises(ValueError):
            buckets.one_to_one(a, b.withColumnRenamed("v", "w"), ["k"])


def test_packed_rows_of_large_slides(spark):
    rows = spark.range(3000).select((F.col("id") % 2 + 1).alias("slide_id"), *[(F.col("id") if c == "l_linenumber" else F.lit(0)).alias(c) for c in P.KEYS])
    got = P.packed_rows(rows)
    assert got.select("packed_row_index").distinct().count() == 3000
    assert got.agg(F.min("packed_row_index"), F.max("packed_row_index")).first()[:] == (0, 2999)
    assert got.where("slide_id = 1").agg(F.max("packed_row_index")).first()[0] == 1499


def test_guards(spark, tmp_path):
    storage = Storage(spark)
    (tmp_path / "x").mkdir()
    (tmp_path / "x/file").write_text("")
    with pytest.raises(ManifestError):
        offline.owned(storage, str(tmp_path / "x"))
    with pytest.raises(ManifestError):
        offline.apart(storage, [str(tmp_path / "a"), str(tmp_path / "a/b")])
    offline.apart(storage, [str(tmp_path / "a"), str(tmp_path / "b")])


def test_fixture_vectors(spark):
    import numpy as np

    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    one, two = ({r.k: r.embedding for r in relations.fixture_vectors(keys, "k", 16).collect()} for _ in range(2))
    assert one == two and abs(np.linalg.norm(one["a"]) - 1) < 1e-6 and one["a"] != one["b"]


def test_stems(spark):
    from lamina.sources.files import SourceError

    inputs = spark.createDataFrame([("/a/s1_patches.h5",)], "path string")
    slides = spark.createDataFrame([("/w/s1.svs",), ("/w/s2.svs",)], "path string")
    assert relations.by_stem(inputs, slides).first().slide_path == "/w/s1.svs"
    with pytest.raises(SourceError):
        relations.by_stem(inputs, slides.unionByName(spark.createDataFrame([("/v/s1.tif",)], "path string")))
    assert mask({}) is not None
