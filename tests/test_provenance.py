import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import evaluation, neighbours, provenance, series
from lamina.sources.files import SourceError


def test_geometry(spark):
    rows = spark.createDataFrame([("a", "256", 512.0, 20)], "path string, patch_size string, patch_size_level0 double, target_magnification int")
    assert provenance.tile_geometry(rows, F.lit(20)).first()[1:] == (256, 512, 20)
    for bad in (rows.withColumn("patch_size", F.lit("0")), rows.withColumn("patch_size_level0", F.lit(1.5)), rows.withColumn("patch_size", F.lit(None).cast("string"))):
        with pytest.raises(SourceError):
            provenance.tile_geometry(bad, F.lit(20))
    with pytest.raises(SourceError):
        provenance.tile_geometry(rows, F.lit(40))


def test_references_and_contracts():
    assert provenance.model_reference("hf_hub:org/model@v1", True) == {"repository": "org/model", "revision": "v1"}
    assert provenance.model_reference("hf:org/model", False)["revision"] is None
    for text in ("hf:org/model", "model"):
        with pytest.raises(SourceError):
            provenance.model_reference(text, True)
    a, b = provenance.contract("index", rows=1), provenance.contract("index", rows=2)
    assert a["sha256"] != b["sha256"] == provenance.contract("index", rows=2)["sha256"]
    assert provenance.index_kind(10) == "int" and provenance.index_kind(2**40) == "long"


def test_files(spark):
    files = spark.createDataFrame([("/t/mag_partition=5x/a.parquet",), ("/t/mag_partition=20x/b.parquet",)], "path string")
    assert {r.magnification for r in provenance.by_magnification(files, [20, 5]).collect()} == {5, 20}
    with pytest.raises(SourceError):
        provenance.by_magnification(files, [5])
    shards = spark.createDataFrame([("a", 3, 2), ("b", 0, 2), ("c", 3, 4)], "path string, coord_rows int, coord_columns int")
    assert [r.path for r in provenance.coordinates_only(shards).collect()] == ["a"]
    out = provenance.exclusion_report(spark.createDataFrame([(40, "s", "p", 20, 7)], "target_magnification int, slide_id string, path string, level0_magnification int, n_tiles int"))
    assert out.first().reason == "target_magnification_above_scan"


def test_automatic_review(spark):
    selection = spark.createDataFrame([("5x:1",), ("5x:1",), ("5x:2",)], "cluster_key string")
    blank = spark.createDataFrame([("5x:1", None, " ")], "cluster_key string, decision string, reviewer string")
    assert provenance.completed_review(selection, blank, "robot", True).count() == 2
    with pytest.raises(SourceError):
        provenance.completed_review(selection, blank, "robot", False)
    with pytest.raises(SourceError):
        provenance.completed_review(selection, blank.withColumn("decision", F.lit("pass")), "robot", True)


def test_nested_and_scattered(spark):
    rows = spark.sql("select struct(struct(3 as y) as x) as a, 1 as index")
    assert provenance.picked(rows, "a.x.y", "v").first().v == 3
    assert evaluation.scattered(rows.unionByName(rows)).count() == 1


def test_probe_grid(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(v) for v in r.normal(0, 0.3, 4) + np.eye(4)[i % 3] * 2], i % 3) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {(x.block, x.rate): x.accuracy for x in evaluation.probe_grid(frame.where("vec_id < 200"), frame.where("vec_id >= 200"), [0.01, 1.0], {"all": (0, 4), "last": (3, 4)}, 3, steps=30).collect()}
    assert got["all", 1.0] > 0.95 and got["last", 1.0] < 0.6 and len(got) == 4


def test_top_k_in_blocks(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(v) for v in r.normal(0, 1, 8)]) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    whole = sorted(map(tuple, neighbours.top_k(frame.where("vec_id % 3 = 0"), frame, 4, skip_self=True).collect()))
    parts = sorted(map(tuple, neighbours.top_k(frame.where("vec_id % 3 = 0"), frame, 4, skip_self=True, block_bytes=700).collect()))
    assert whole == parts and len(whole) == 160
    x = np.array([v for _, v in rows], np.float32).astype(float)
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -np.inf)
    assert [b for a, b, _, rank in whole if a == 3] == sorted(np.lexsort((np.arange(120), -s[3]))[:4].tolist()) or {b for a, b, _, _ in whole if a == 3} == set(np.lexsort((np.arange(120), -s[3]))[:4].tolist())
    assert neighbours.top_k(frame.limit(0), frame, 4).count() == 0


def test_windows_in_chunks(spark):
    """Long groups give the same meters and runs when they are dealt to many windows."""
    r = np.random.default_rng(2)
    rows = [(i, "ab"[int(i % 50 == 0)], int(t), None if i % 37 == 0 else float(v)) for i, (t, v) in enumerate(zip(r.integers(0, 400, 1500), r.normal(0, 1, 1500), strict=True))]
    frame = spark.createDataFrame(rows, "id long, g string, ts int, value double").repartition(4)
    for run in (lambda c: series.trailing(frame, "g", ["ts", "id"], "value", 20, chunk=c), lambda c: series.islands(frame, "g", ["ts", "id"], F.coalesce(F.col("value") > 0, F.lit(False)), chunk=c)):
        flat = lambda x: sorted((tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in row) for row in x.collect()), key=str)
        assert flat(run(100_000)) == flat(run(64)) and run(64).count() > 100
